"""Column functions over text: cleaning, case, syllables, parsing. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide whether a line of a book is dropped. ``[\p{L}\p{N}_]`` is what
# counts as a word character there; a run of six symbols or spaces is a symbol block.
DROP_LINE = {
    "numeric_only": r"(?U)^[\d\s.\-/]+$",
    "long_symbol_block": r"[^\p{L}\p{N}_]{6}",
    "short_full_caps": r"(?U)^[\p{Lu}\s]{1,30}$",
    "roman_numerals": r"(?iU)^\s*[ivxlcdm]{1,7}\s*$",
    "footnote_refs": r"(?U)^\s*(?:\d+|\*+|†+|‡+)\s+",
    "copyright": r"(?iU)©|\bcopyright\b|\ball rights reserved\b",
    "brackets_content": r"^\[[^\]]*\]$",
    "isbn": r"(?iU)\bisbn[-:\s]*(?:\d[-\s]*){9}[\dx]\b",
    "table_of_contents": r"(?iU)table of contents|\.{5}|\s{5}\d+$",
    "chapter_headers": r"(?iU)^\s*prologue|epilogue|(?:chapter|ch\.?|part|section|§|act|volume)\s+(?:[ivxlcdm]{1,7}|\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)[.:\s]*$",
    "website_urls": r"(?iU)https?://\S|www\.\S|\S\.com\b",
}
# Words that mark front and back matter, also inside other words.
METADATA_WORDS = (
    "acknowledgment", "acknowledgement", "preface", "foreword", "introduction", "table of contents", "contents", "list of chapters", "index",
    "bibliography", "references", "appendix", "about the author", "author's note", "biography", "glossary", "notes", "epigraph", "prologue",
    "epilogue", "afterword", "etext", "published", "publisher", "publications", "was updated by",
)
# Lines that hold nothing but a page number, and line ends inside a sentence.
PAGE_NUMBER = r"(?imdU)^[\s\[]*(?:page)?\.?\s*(?:[ivxlcdm]{1,7}|\d+)\.?[\]\s]*$"
#: The look-ahead for a line end comes first, so the look-behinds run at line ends only.
BROKEN_LINE = r"""(?U)(?<=\S)(?=\s*\n)(?:(?<=[\w,;'–—-][")\]>]?)|(?<= "[^\n"]{1,9999}[?!.]))\s*\n\s*(?=[\w,;(\[<"'–—-])"""


def preprocessed(t: Column) -> Column:
    """CLN1: carriage returns dropped, typographic quotes and full-width marks made plain."""
    return F.translate(t, "’“”？！\r", "'\"\"?!")


def before_clean(t: Column) -> Column:
    """CLN2: trimmed, plain quotes, page-number lines deleted, sentences broken over lines joined.
    (Of a sentence in quotes that a line break follows, up to 9,999 characters are looked back at.)"""
    plain = F.translate(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), "’“”\r﻿", "'\"\"")
    return F.regexp_replace(F.regexp_replace(plain, PAGE_NUMBER, ""), BROKEN_LINE, " ")


def paragraphs_joined(t: Column) -> Column:
    """CLN3: a character, an empty line and indentation become the character and a space."""
    return F.regexp_replace(t, r"(\S)\n\n[ \t]*", "$1 ")


def casefolded(t: Column) -> Column:
    """LEX3: lower case with ß as ss."""
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def plain_case(line: Column) -> Column:
    """Lower case in which all that a pattern takes for a letter of a to z, whatever its case, is that letter."""
    return F.lower(F.translate(line, "ſKıİ", "skii"))


def any_of(t: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(t, F.lit(part))
    return hit


#: What a line (in plain case) has to hold for a pattern that is not bound to its start, as a cheap test before it.
HOLDS = {
    "copyright": ("©", "copyright", "all rights reserved"),
    "isbn": ("isbn",),
    "chapter_headers": ("prologue", "epilogue", "chapter", "ch", "part", "section", "§", "act", "volume"),
    "website_urls": ("http", "www.", ".com"),
}


def dropped_line(line: Column, low: Column | None = None) -> Column:
    """CLN6: whether any of the drop patterns hits; cheap ones first. ``low`` is the line in plain case."""
    low = plain_case(line) if low is None else low
    hit = F.lit(False)
    for name, pattern in DROP_LINE.items():
        if name == "table_of_contents":
            found = (any_of(low, "table of contents", ".....") | line.rlike(r"(?U)\d\s*$")) & line.rlike(pattern)
        else:
            found = any_of(low, *HOLDS[name]) & line.rlike(pattern) if name in HOLDS else line.rlike(pattern)
        hit = hit | found
    return hit


def keyword_hits(line: Column) -> Column:
    """CLN7: occurrences of front-matter words that don't overlap."""
    low = F.lower(line)
    return F.when(any_of(low, *METADATA_WORDS), F.regexp_count(low, F.lit("|".join(METADATA_WORDS)))).otherwise(F.when(line.isNotNull(), 0))


def long_enough(line: Column) -> Column:
    """CLN8: more than five words."""
    return F.size(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))) > 5


def slug(title: Column) -> Column:
    """CLN12: lower case, runs of other characters as one hyphen."""
    return F.btrim(F.lower(F.regexp_replace(title, "[^A-Za-z0-9]+", "-")), F.lit("-"))


# Spellings of fewer syllables than vowel groups, in the order of the published list.
SYLLABLE_LESS = (
    "cial", "tia", "cius", "cious", "uiet", "gious", "geous", "priest", "giu", "dge", "ion", "iou", "sia$", ".che$", ".ched$", ".abe$", ".ace$",
    ".ade$", ".age$", ".aged$", ".ake$", ".ale$", ".aled$", ".ales$", ".ane$", ".ame$", ".ape$", ".are$", ".ase$", ".ashed$", ".asque$", ".ate$",
    ".ave$", ".azed$", ".awe$", ".aze$", ".aped$", ".athe$", ".athes$", ".ece$", ".ese$", ".esque$", ".esques$", ".eze$", ".gue$", ".ibe$", ".ice$",
    ".ide$", ".ife$", ".ike$", ".ile$", ".ime$", ".ine$", ".ipe$", ".iped$", ".ire$", ".ise$", ".ished$", ".ite$", ".ive$", ".ize$", ".obe$",
    ".ode$", ".oke$", ".ole$", ".ome$", ".one$", ".ope$", ".oque$", ".ore$", ".ose$", ".osque$", ".osques$", ".ote$", ".ove$", ".pped$", ".sse$",
    ".ssed$", ".ste$", ".ube$", ".uce$", ".ude$", ".uge$", ".uke$", ".ule$", ".ules$", ".uled$", ".ume$", ".une$", ".upe$", ".ure$", ".use$",
    ".ushed$", ".ute$", ".ved$", ".we$", ".wes$", ".wed$", ".yse$", ".yze$", ".rse$", ".red$", ".rce$", ".rde$", ".ily$", ".ely$", ".des$",
    ".gged$", ".kes$", ".ced$", ".ked$", ".med$", ".mes$", ".ned$", ".[sz]ed$", ".nce$", ".rles$", ".nes$", ".pes$", ".tes$", ".res$", ".ves$",
    "ere$",
)
# Spellings of more syllables than vowel groups; one of them counts twice.
SYLLABLE_MORE = (
    "ia", "riet", "dien", "ien", "iet", "iu", "iest", "io", "ii", "ily", ".oala$", ".iara$", ".ying$", ".earest", ".arer", ".aress", ".eate$",
    ".eation$", "[aeiouym]bl$", "[aeiou]{3}", "^mc", "ism", "^mc", "asm", "([^aeiouy])1l$", "[^l]lien", "^coa[dglx].", "[^gq]ua[^auieo]", "dnt$",
)


def hits_of(w: Column, patterns: tuple[str, ...]) -> Column:
    """How many of ``patterns`` a word matches. Plain endings after any character are set lookups by
    length, plain parts substring tests; only the rest are regular expressions."""
    endings: dict[int, list[str]] = {}
    terms = []
    for p in patterns:
        if p[0] == "." and p[-1] == "$" and p[1:-1].isalpha():
            endings.setdefault(len(p) - 2, []).append(p[1:-1])
        else:
            terms.append(F.contains(w, F.lit(p)) if p.isalpha() else w.rlike(p))
    terms += [(F.length(w) > n) & F.right(w, F.lit(n)).isin(found) for n, found in sorted(endings.items())]
    return sum((t.cast("int") for t in terms[1:]), terms[0].cast("int"))


def syllables(word: Column) -> Column:
    """LEX4: vowel groups, less one for each spelling of fewer and more by one for each of more, at
    least 1; null for null. The word in lower case is bound once, as an element: written out, the spellings would be one
    generated method that is too large to be compiled."""
    count = lambda w: F.regexp_count(w, F.lit("[aeiouy]+")) - hits_of(w, SYLLABLE_LESS) + hits_of(w, SYLLABLE_MORE)
    found = F.get(F.transform(F.array(F.lower(word)), count), F.lit(0))
    return F.when(word.isNotNull(), F.greatest(found, F.lit(1))).cast("int")


def parsed_rating(output: Column) -> Column:
    """SCR2: ``rating`` of the JSON between the first brace and the last, else the last integer
    without a hyphen beside it; null outside 0..5."""
    start, stop = F.instr(output, "{"), F.length(output) - F.instr(F.reverse(output), "}") + 1
    body = F.when((start > 0) & (F.instr(output, "}") > 0) & (stop > start), output.substr(start, stop - start + 1))
    from_json = F.get_json_object(body, "$.rating").try_cast("int")
    last = F.try_element_at(F.regexp_extract_all(output, F.lit(r"((?<!-)\d+(?!-))"), F.lit(1)), F.lit(-1)).try_cast("int")
    value = F.coalesce(from_json, last)
    return F.when(value.between(0, 5), value)


def quoted_share(t: Column) -> Column:
    """FEA1: characters inside closed quotes (an opener closes with its own kind; apostrophes open,
    too) by length. An opener that never closes swallows the rest, so this is a fold over the
    quote marks and not a pattern."""
    marks = F.regexp_extract_all(t, F.lit(r"([^\"']*+[\"']|[^\"']++)"), F.lit(1))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("held"), F.lit(0).alias("total"))

    def step(s, part):
        mark, inside = F.regexp_extract(part, "[\"']$", 0), F.length(part) - 1
        closes, idle = (s["open"] == mark) & (mark != ""), s["open"] == ""
        return F.struct(
            F.when(idle, mark).when(closes, F.lit("")).otherwise(s["open"]).alias("open"),
            F.when(idle | closes, F.lit(0)).otherwise(s["held"] + inside + 1).alias("held"),
            F.when(closes, s["total"] + s["held"] + inside).otherwise(s["total"]).alias("total"),
        )

    return F.coalesce(F.try_divide(F.aggregate(marks, start, step, lambda s: s["total"]).cast("double"), F.length(t)), F.lit(0.0))


def char_ngrams(t: Column, low: int = 2, high: int = 5) -> Column:
    """FEA2: all character n-grams of the case-folded text."""
    grams = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(casefolded(t), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def characters(t: Column) -> Column:
    """The characters of a text as an array; an empty text has none."""
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def array_ngrams(c: Column, low: int = 2, high: int = 5) -> Column:
    """FEA2 on the array of a folded text's characters (a column of its own, else it is split again
    for each n-gram): in time that grows with the length and not with its square."""
    grams = lambda n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def case_class(word: Column) -> Column:
    """FEA14: lower, upper, title or null, tested in that order on words with letters."""
    letters = word.rlike(r"\p{L}")
    title = word.rlike(r"^\P{L}*(\p{Lu}\p{Ll}*)(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$")
    return F.when(letters & (word == F.lower(word)), "lower").when(letters & (word == F.upper(word)), "upper").when(title, "title")


def expected_position(p: Column) -> Column:
    """SCR1: probabilities of ordered labels to an expected position in 0..1."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    k = F.size(p)
    value = F.try_divide(weighed, total * (k - 1))
    return F.when((k == 0) | (total <= 0), 0.0).when(k == 1, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
