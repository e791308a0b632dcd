"""Personal data: fixed patterns, and bootstrapped contextual extraction on top of them.

What the fixed patterns find seeds a graph. Its two sides are instances (strings shaped like
identifiers) and lexical patterns (the words before or after an occurrence). Spark scores the graph
in rounds: a pattern is accepted for a kind if enough of its distinct instances are of that kind,
surely more than elsewhere; instances that accepted patterns point to are weighed with what is known
of the others of their shape (nothing, for a new shape), become confident and count in the next
round. Occurrences of confident instances are added to the spans of the fixed patterns, which always
stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, cleared, frugal, row_of, small_side, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole and only from its first digit: where that fails, so does any
# later start in the run, and the search stays linear in the length of the text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds end when the confident instances are those of an earlier round, or after this many.
ROUNDS = 40
#: A pattern needs this lower bound (95 %) of its share of instances of a kind, and has to close at
#: least half the way from the kind's share of the instances without the pattern to 1.
SURE = 0.7
#: An instance counts as found from this confidence on.
CONFIDENT = 0.8
LEFT, RIGHT = 64, 40  # characters around an occurrence that its words are taken from
KEPT = 80  # characters up to which a string stands for itself in the graph, and not by its digest

SPAN = "struct<start:long,k:int,end:long>"
OCCURRENCE = "struct<start:long,end:long,kind:int,instance:string,shape:string,patterns:array<string>>"
FOUND = f"row_id long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, seen array<{OCCURRENCE}>"

TOKEN = re.compile(r"[0-9@]\S*")
DIGITS = re.compile(r"[0-9().+-]+")
EDGE = "\"'`([{<>}]).,;:!?|*#%&$"
RUNS = re.compile(r"[0-9]+|[^\W\d_]+|\s+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, from one @ to the next."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's number, end)`` in code points, ordered by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape_of(s: str) -> str:
    """The string with its runs of digits, letters and spaces reduced to a mark, and the number of its
    digits."""
    if "@" in s:
        return "mail"
    flat = RUNS.sub(lambda m: "9" if m.group()[0].isdigit() else " " if m.group().isspace() else "a", s)
    return f"{named(flat)}:{sum(map(str.isdigit, s))}"


def named(s: str) -> str:
    """What stands for a string in the graph: itself, or a digest (which keeps an @) of a long one."""
    return s if len(s) <= KEPT else f"{'@' * ('@' in s)}#{hashlib.sha256(s.encode('utf-8', 'surrogatepass')).hexdigest()}"


def around(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns of an occurrence: one word before, two words before, one word after."""
    before = [w for w in (x.lower().lstrip(EDGE).rstrip("\"'`([{<>}]).,;!?|*#%&$") for x in text[max(0, a - LEFT) : a].split()) if w][-2:]
    after = [w for w in (x.lower().strip(EDGE) for x in text[b : b + RIGHT].split()[:1]) if w]
    out = [f"1 {before[-1]} _"] if before else []
    if len(before) == 2:
        out.append(f"2 {before[0]} {before[1]} _")
    if after:
        out.append(f"3 _ {after[0]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings shaped like identifiers that no span of ``base`` touches: with an @ and a letter, or
    with five digits; groups of digits a space apart are one."""
    tokens: list[tuple[int, int]] = []
    low = 0
    for m in TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while a > low and not text[a - 1].isspace():
            a -= 1
        low = b
        while a < b and text[a] in EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in EDGE and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        sign = max(text.rfind("=", a, b), text.rfind(":", a, b))
        if sign >= 0 and any(map(str.isdigit, text[sign:b])):
            a = sign + 1
        if tokens and a - tokens[-1][1] == 1 and text[a - 1] == " " and DIGITS.fullmatch(text, a, b) and DIGITS.fullmatch(text, text.rfind(" ", tokens[-1][0], tokens[-1][1]) + 1 or tokens[-1][0], tokens[-1][1]):
            tokens[-1] = (tokens[-1][0], b)
        elif a < b:
            tokens.append((a, b))
    starts, reach = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    out = []
    for a, b in tokens:
        before = bisect_left(starts, b)
        if before and reach[before - 1] > a:  # a base span touches it
            continue
        s = text[a:b]
        if sum(map(str.isdigit, s)) >= 5 or ("@" in s[1:-1] and any(map(str.isalpha, s))):
            out.append((a, b))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    rows = [(a, b, k) for a, k, b in base] + [(a, b, None) for a, b in candidates(text, base)]
    out = []
    for a, b, k in rows:
        s = text[a:b].lower()
        out.append({"start": a, "end": b, "kind": k, "instance": named(s), "shape": shape_of(s), "patterns": around(text, a, b)})
    return out


def found(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Base spans and all occurrences of each row of ``docs``, as a table in the shared folder;
    with the columns of ``docs`` (under ``doc``) if ``carry``. Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([row_of(docs).alias("doc")] if carry else []))
    kept = [f for f in source.schema if f.name == "doc"]
    span = pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64())])
    seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("shape", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                counts = [sum(x[1] == k for x in base) for k in range(4)]
                for col, value in zip(cols, (row, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), [{"start": a, "k": k, "end": b} for a, k, b in base], occurrences(text, base))):
                    col.append(value)
                row += 1
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(span), pa.list_(seen)]
            made = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["row_id", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"]
            yield pa.RecordBatch.from_arrays([made[0], batch.column(0), *made[1:], *([batch.column(2)] if kept else [])], names + [f.name for f in kept])

    schema = FOUND + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    return written(source.mapInArrow(frugal(run), schema), "pii")


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share of ``hits`` in ``n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def discovered(table: DataFrame, rounds: int = ROUNDS, sure: float = SURE, confident: float = CONFIDENT) -> DataFrame | None:
    """``instance, k``: the instances that accepted patterns point to; None if no pattern is.

    The graph has a row per distinct pair of pattern and instance, so copies of a document weigh
    nothing; sums per pattern are formed before the shuffle, so common words make no hot task.

    A shape (with its number of digits) is a feature beside the patterns: the odds of an instance are
    those of its patterns times those of the shape's other instances to be of the kind, with one
    added on either side. So a shape that no seed has is no bar, and one that mostly stands elsewhere is.
    Only what holds an @ can be an e-mail address, and it can be nothing else.
    """
    ks = range(len(KINDS))
    mail = F.expr("instance LIKE '%@%'")
    seen = table.select(F.explode("seen").alias("o")).select("o.*")
    nodes = written(seen.groupBy("instance", "shape").agg(F.max("kind").alias("kind")).select("instance", F.col("shape").alias("form"), "kind"), "pii-nodes")
    edges = written(seen.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    seeds = [F.count_if(F.col("kind") == k).cast("double").alias(f"s{k}") for k in ks]
    forms = written(nodes.groupBy("form").agg(F.count("*").cast("double").alias("m"), *seeds), "pii-forms")
    total = forms.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in ks]).first()
    believed, marks = None, set()
    for step in range(rounds):
        if believed is not None:
            weighed = edges.join(small_side(believed), "instance", "left")
        else:
            weighed = edges.withColumn("k", F.lit(None).cast("int")).withColumn("conf", F.lit(None).cast("double"))
        credit = [F.sum(F.when(F.col("kind") == k, 1.0).when(F.col("kind").isNull() & (F.col("k") == k), F.col("conf")).otherwise(0.0)).alias(f"c{k}") for k in ks]
        own = [F.count_if(F.col("kind") == k).cast("double").alias(f"o{k}") for k in ks]
        sums = weighed.groupBy("pattern").agg(F.count("*").cast("double").alias("n"), *credit, *own)
        elsewhere = lambda k: F.greatest(F.lit(total[f"s{k}"]) - F.col(f"o{k}"), F.lit(0.0)) / F.greatest(F.lit(total["m"]) - F.col("n"), F.lit(1.0))
        scored = sums.select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), wilson(F.least(F.col(f"c{k}"), F.col("n")), F.col("n")).alias("score"), elsewhere(k).alias("prior")) for k in ks])).alias("s")).select("pattern", "s.*")
        accepted = written(scored.filter((F.col("score") >= sure) & (F.col("score") >= (1 + F.col("prior")) / 2)).select("pattern", "k", "score"), f"pii-patterns{step}")
        if accepted.isEmpty():
            return None
        pointed = edges.filter("kind IS NULL").join(small_side(accepted), "pattern").filter(mail == (F.col("k") == 0))
        votes = written(pointed.groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))).alias("conf")), f"pii-votes{step}")
        held = written(votes.join(nodes.select("instance", "form"), "instance"), f"pii-held{step}")
        called = held.groupBy("form", "k").agg(F.sum("conf").alias("called"))
        known = forms.join(called, "form").select("form", "k", "m", (F.element_at(F.array(*[f"s{k}" for k in ks]), F.col("k") + 1) + F.col("called")).alias("hits"))
        weight = held.join(small_side(written(known, f"pii-known{step}")), ["form", "k"])
        others = F.greatest(F.col("hits") - F.col("conf"), F.lit(0.0)) + 1
        against = F.greatest(F.col("m") - 1 - (others - 1), F.lit(0.0)) + 1
        odds = F.col("conf") / F.greatest(1 - F.col("conf"), F.lit(1e-9)) * others / against
        rated = weight.select("instance", "k", (odds / (1 + odds)).alias("conf"))
        believed = written(rated.groupBy("instance").agg(F.max(F.struct("conf", (-F.col("k")).alias("of"))).alias("m")).select("instance", (-F.col("m.of")).cast("int").alias("k"), "m.conf"), f"pii-believed{step}")
        sure_ones = believed.filter(F.col("conf") >= confident)
        mark = tuple(sure_ones.agg(F.count("*"), F.sum(F.xxhash64("instance", "k") % 1_000_003)).first())
        if mark in marks:  # the same, or one of a few states that would alternate for ever
            break
        marks.add(mark)
    return sure_ones.select("instance", "k")


def settled(table: DataFrame, **how) -> DataFrame | None:
    """:func:`discovered` as a table of its own; the tables of its rounds are deleted."""
    with cleared(table.sparkSession) as made:
        more = discovered(table, **how)
        if more is not None:
            more = written(more, "pii-discovered")
            made.pop()
    return more


def with_spans(docs: DataFrame, carry: bool = False, **how) -> DataFrame:
    """The table of :func:`found` with ``all``: the spans of fixed patterns and of discovered
    instances, ordered by start and then kind. Null and empty texts have none, repeated rows are each
    returned, and no rows give none."""
    table = found(docs, carry)
    more = settled(table, **how)
    if more is None:
        return table.withColumn("all", F.col("base"))
    seen = table.select("row_id", F.explode("seen").alias("o")).select("row_id", "o.*").filter("kind IS NULL")
    extra = seen.join(small_side(more), "instance").groupBy("row_id").agg(F.collect_list(F.struct("start", "k", "end")).alias("extra"))
    return table.join(extra, "row_id", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as array<{SPAN}>)"))))).drop("extra")


def span_text(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with its spans, ordered by start, replaced by their kinds; of overlapping ones the first."""
    parts, at = [], 0
    for a, k, b in spans:
        if b > at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
            at = b
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, most: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows and columns of ``docs`` with every span of personal data replaced by its kind in
    angle brackets; ``n_chars``, where there is one, counts the new text. Null texts stay null, repeated
    rows are each returned, and no rows give none.

    Up to ``most`` discovered instances travel with the tasks, which look the texts' strings up, and
    no table stays; more are joined to the spans of a table that carries the rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names, schema, known = docs.columns, docs.schema, {}
    with cleared(spark):
        more = settled(found(docs), **how)
        if more is not None:
            few = more.limit(most + 1).collect()
            known = {r["instance"]: r["k"] for r in few} if len(few) <= most else None
    looked_up = known is not None
    shared = spark.sparkContext.broadcast(known or {})

    def spans_of(text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        if not shared.value:
            return base
        strings = ((a, shared.value.get(named(text[a:b].lower())), b) for a, b in candidates(text, base))
        return sorted(base + [x for x in strings if x[1] is not None])

    def run(batches):
        for batch in batches:
            cols = dict(zip(names, batch.columns if looked_up else batch.column(0).flatten()))
            held = cols["text"].to_pylist()
            spans = map(spans_of, (t or "" for t in held)) if looked_up else ([(s["start"], s["k"], s["end"]) for s in x] for x in batch.column(1).to_pylist())
            texts = [text and hidden(text, x) for text, x in zip(held, spans)]
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    rows = docs if looked_up else with_spans(docs, True, **how).select("doc", F.col("all").alias("spans"))
    return rows.mapInArrow(frugal(run), schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: a row per row; null and empty texts have no spans. ``n_spans``
    counts those of all kinds, discovered ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", span_text("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))
