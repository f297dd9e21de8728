"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Seeds are entities that a strict pattern and a check confirm (e-mail and IP addresses, card and phone numbers).
Looser candidates of each kind are collected too.  The words around an entity are its lexical patterns: two words
on its left, two on its right, one on either side, and, as back-off, the one word on its left; digits in them count
as 0.  Patterns and instances (distinct values of a kind) form a graph.  It is scored in rounds: a pattern is
worth the share of its instances that are known; the candidates behind a pattern of enough known instances
and enough worth become known themselves, and so induce patterns where they stand elsewhere.  The known only grow,
and the rounds end when one adds nothing.  Candidates behind a pattern that is trusted then are added spans.

Spans depend on nothing but the text and the patterns, so rows are matched by a 128-bit hash of their text: no
row numbers, which a second reading of a shuffled input would give to other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.llm.arrays import below, chunks, let, root, running, upto
from quietsignal.llm.common import shared_checkpoints, table

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns.  Possessive quantifiers and the look-behinds change no match; they keep scans linear.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates: spelled-out addresses, long IP addresses, numbers of card length, numbers without a country.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,11}(?![0-9A-Za-z])",
}
#: What any text with a match of the strict and of the loose pattern contains.
GATES = {"email": ("@", r"at[\])]"), "ip": (".", r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": (None, r"[0-9][\x20-]?[0-9]"), "phone": ("+", r"[0-9][\x20().-]{0,2}[0-9]")}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Patterns by form: l2, two words on the left; r2, two on the right; lr, one on either side; l1, one on the left.
#: With each form, the distinct known instances that it needs, and the share of known ones among all.
FORMS = {"l2": (3, 0.8), "r2": (3, 0.8), "lr": (3, 0.8), "l1": (20, 0.9)}
CONTEXT_CHARS = 80
#: Rows up to which spans and patterns are broadcast, about 30 MB; above, they are joined.
BROADCAST_ROWS = 1_000_000
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    back = F.reverse(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d >= 5, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def confirmed(kind: Column, value: Column) -> Column:
    """Whether a match of a strict pattern passes the check of its kind (a place in KINDS)."""
    digits = F.translate(value, " -", "")
    card = F.length(digits).between(12, 19) & luhn(F.when(F.length(digits).between(12, 19), digits).otherwise("0"))
    phone = F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.when(kind == 1, value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")).when(kind == 2, card).when(kind == 3, phone).otherwise(True)


def words(gap: Column, left: bool) -> Column:
    """The two words of a gap that are nearest to the match on its right (``left``) or on its left."""
    near = F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS) if left else F.substring(gap, 1, CONTEXT_CHARS)
    every = F.array_remove(F.split(F.regexp_replace(F.lower(near), "[0-9]", "0"), r"\s+"), "")
    return let(every, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)) if left else F.lit(1), F.lit(2)), " "))


def scanned(text: Column, kind: int, sure: bool, regex: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches of a pattern, and the gaps between them."""
    return let(F.when(gate, F.regexp_extract_all(text, F.lit(regex), F.lit(0))), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("sure"), m.alias("m"), F.when(F.size(m) > 0, F.split(text, regex, -1)).alias("g")))


def places(scan: Column) -> Column:
    """Code point spans, values and contexts of a scan's matches; of strict patterns only confirmed ones.

    The gaps between matches give the places by a running sum of lengths; contexts are read from the gaps too.
    """
    lengths = F.transform(scan["m"], lambda x, i: (F.length(x) + F.length(F.get(scan["g"], i))).cast("long"))
    chosen = F.filter(upto(F.size(scan["m"])), lambda i: ~scan["sure"] | confirmed(scan["kind"], F.get(scan["m"], i)))

    def one(i: Column, at: Column) -> Column:
        value, before, after = F.get(scan["m"], i), F.get(scan["g"], i), F.get(scan["g"], i + 1)
        start = F.get(at, i) + F.length(before)
        return F.struct(start.alias("start"), scan["kind"].alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), words(before, True).alias("left"), words(after, False).alias("right"))

    return let(running(lengths, lambda a, x: a + x), lambda at: F.transform(chosen, lambda i: one(i, at)))


def untouched(loose: Column, strict: Column) -> Column:
    """Those of ``loose`` that overlap none of ``strict``, which is sorted by start."""

    def against(starts: Column, ends: Column) -> Column:
        def free(s: Column) -> Column:
            n = below(starts, s["end"])
            return F.coalesce(F.get(ends, n) <= s["start"], F.lit(True))

        return F.filter(loose, free)

    # ends: the greatest end of the first n strict spans.
    greatest = let(F.transform(strict, lambda s: s["end"]), lambda e: F.concat(running(e, F.greatest), F.array(F.array_max(e))))
    checked = let(F.transform(strict, lambda s: s["start"]), lambda starts: let(greatest, lambda ends: against(starts, ends)))
    return F.when((F.size(loose) == 0) | (F.size(strict) == 0), loose).otherwise(checked)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, 128 bits of the text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__k1", F.xxhash64(text)).withColumn("__k2", F.xxhash64(F.lit(7), text))


KEY = ["__k1", "__k2"]


def candidates(docs: DataFrame) -> DataFrame:
    """The text's key, doc_id, strict and loose spans of every row; loose ones that touch a strict one are left out."""
    text = F.col("text")
    scans = []
    for k, kind in enumerate(KINDS):
        sign, loose = GATES[kind]
        scans.append(scanned(text, k, True, STRICT[kind], text.contains(sign) if sign else text.rlike("[0-9]{2}|[0-9][ -][0-9]")))
        scans.append(scanned(text, k, False, LOOSE[kind], text.rlike(loose)))
    found = F.transform(F.filter(F.array(*scans), lambda x: F.size(x["m"]) > 0), lambda x: F.struct(x["sure"].alias("sure"), places(x).alias("spans")))
    of = lambda v, sure: F.flatten(F.transform(F.filter(v, lambda x: x["sure"] == sure), lambda x: x["spans"]))
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    both = let(let(found, lambda v: F.struct(F.array_sort(of(v, True)).alias("strict"), of(v, False).alias("loose"))), lambda v: F.struct(v["strict"].alias("strict"), untouched(v["loose"], v["strict"]).alias("loose")))
    return rows.select(*KEY, "doc_id", both.alias("v")).select(*KEY, "doc_id", "v.*")


def pattern_of(form: str, left: Column, right: Column) -> Column:
    """The context of a form; null where there are too few words."""
    last, first = F.substring_index(left, " ", -1), F.substring_index(right, " ", 1)
    if form == "l2":
        return F.when(left.contains(" "), left)
    if form == "r2":
        return F.when(right.contains(" "), right)
    if form == "lr":
        return F.when((left != "") & (right != ""), F.concat_ws(" _ ", last, first))
    return F.when(left != "", last)


def small(frame: DataFrame) -> DataFrame:
    """``frame`` (checkpointed) for a join: broadcast only if its rows are few."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def bootstrap(found: DataFrame, forms: dict[str, tuple[int, float]] = FORMS) -> DataFrame:
    """The text's key and the spans that trusted patterns add.  Edges are distinct: repeated texts are no evidence."""
    flat = lambda c, seed: found.select(*KEY, F.explode(c).alias("s")).select(*KEY, "s.*", F.lit(seed).alias("seed"))
    # Without a loose candidate there is nothing to discover, and no pattern to score.
    loose = flat("loose", False)
    pattern = ["kind", "form", "context"]
    contexts = F.array(*[F.struct(F.lit(f).alias("form"), pattern_of(f, F.col("left"), F.col("right")).alias("context")) for f in forms])
    by_form = lambda rows: rows.select(*KEY, "kind", "start", "end", F.lower("value").alias("value"), "seed", F.explode(contexts).alias("c")).select("*", "c.*").where(F.col("context").isNotNull())
    every = by_form(flat("strict", True).unionByName(loose))
    edges = every.groupBy(*pattern, "value").agg(F.max("seed").alias("seed"))
    limits = F.create_map(*[F.lit(x) for f, (n, _) in forms.items() for x in (f, n)])[F.col("form")], F.create_map(*[F.lit(x) for f, (_, w) in forms.items() for x in (f, w)])[F.col("form")]
    # A pattern matters only if it holds a candidate, and enough instances that could become known.
    open_ = edges.groupBy(pattern).agg(F.count("*").alias("n"), F.count_if(~F.col("seed")).alias("others")).where((F.col("others") > 0) & (F.col("n") > limits[0])).select(pattern).checkpoint()
    if open_.isEmpty():
        return every.groupBy(KEY).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")).where("false")
    edges = edges.join(small(open_), pattern, "left_semi").checkpoint()
    known = edges.where("seed").select("kind", "value").distinct()
    size = -1
    while True:
        known = known.checkpoint()
        now = known.count()
        marked = edges.join(small(known.withColumn("known", F.lit(True))), ["kind", "value"], "left")
        scored = marked.groupBy(pattern).agg(F.count("known").alias("known"), F.count("*").alias("n"))
        trusted = scored.where((F.col("known") >= limits[0]) & (F.col("known") >= limits[1] * F.col("n"))).select(pattern).checkpoint()
        if now == size:
            break
        size = now
        known = known.unionByName(edges.join(small(trusted), pattern, "left_semi").select("kind", "value")).distinct()
    hits = by_form(loose).join(small(trusted), pattern, "left_semi")
    return hits.groupBy(KEY).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")).checkpoint()


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def keyed_spans(docs: DataFrame, forms: dict[str, tuple[int, float]] = FORMS) -> DataFrame:
    shared_checkpoints(docs.sparkSession)
    found = candidates(docs).checkpoint()
    bare = F.transform("strict", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.expr(f"CAST(array() AS {SPANS})")
    own = found.join(small(bootstrap(found, forms)), KEY, "left")
    return own.select(*KEY, "doc_id", bare.alias("base"), F.array_sort(F.concat(bare, F.coalesce("more", none))).alias("spans"))


def extract(docs: DataFrame, forms: dict[str, tuple[int, float]] = FORMS) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end by start, then kind) of every row.

    Null and empty texts have no spans.  Repeated rows are kept and count once as evidence, because edges hold
    distinct instances.  Other columns are not read.  An added span touches no base span; those of different
    kinds may overlap each other, as base spans may.
    """
    return keyed_spans(docs, forms).drop(*KEY)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with its spans, sorted by start, replaced.  Blocks of spans are cut out first, then spans of a block."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    piece = lambda s, a, b: F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))

    def of(before: Column) -> Column:  # the greatest end of the spans before each
        cuts = F.filter(F.transform(spans, lambda s, i: F.struct(F.get(before, i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda c: c["start"] >= c["at"])
        return let(cuts, lambda c: let(chunks(c, root(c)), joined))

    def joined(blocks: Column) -> Column:
        def block(b: Column, k: Column) -> Column:
            first, last = F.get(b, F.lit(0))["at"], F.get(F.get(blocks, k + 1), F.lit(0))["at"]
            end = F.coalesce(last, F.element_at(b, -1)["start"])
            return let(piece(text, first, end), lambda t: F.array_join(F.transform(b, lambda c: F.concat(piece(t, c["at"] - first, c["start"] - first), F.get(names, c["kind"]))), ""))

        return F.array_join(F.transform(blocks, block), "")

    tail = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.lit(2_000_000_000))
    return F.concat(let(running(F.transform(spans, lambda s: s["end"]), F.greatest), of), tail)


def mask(docs: DataFrame, forms: dict[str, tuple[int, float]] = FORMS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; ``n_chars`` follows.

    Spans of different kinds that overlap are replaced together, under the kind that starts first.  Null texts,
    and texts without a span, stay as they are; rows are not lost or merged, whatever their ids.  Columns keep
    their names and order.
    """
    spans = keyed_spans(docs.select("doc_id", "text"), forms).where(F.size("spans") > 0).groupBy(KEY).agg(F.first("spans").alias("__spans")).checkpoint()
    many = spans.agg(F.sum(F.size("__spans") + 1)).first()[0] or 0
    out = keyed(docs).join(F.broadcast(spans) if many <= BROADCAST_ROWS else spans, KEY, "left")
    out = out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
