"""Benchmark decontamination with DataFrame operations only.

Every item's windows of consecutive words are hashed; the set is broadcast where its counted size allows
that and joined by a shuffle beyond it.  Each document gives a hash for each of its windows; hits are
verified by comparing the words themselves.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.  A window is
``size`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: a null or wordless text has no words and no hits; repeated document rows are reported
as often as they come; repeated items count once for each item_id and items with a null item_id are left
out; an empty benchmark hits nothing; further columns are ignored (report) or kept (clean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that are broadcast at most, about 250 bytes each.  More are joined by a shuffle.
BROADCAST_WINDOWS = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEXT_KEY = "__text_key"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _BETWEEN), "")


def _starts(w: str, n: int) -> str:
    """SQL for the positions, from 1, of windows of n words."""
    return f"if(size({w}) >= {n}, sequence(1, size({w}) - {n} + 1), cast(array() as array<int>))"


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """n, w (the words), h (their hash), items (the ids of items with the window), one row for each window."""
    b = benchmark.where("item_id is not null").select("item_id", F.explode(F.array(words(F.col("text")))).alias("ws")).where("size(ws) > 0")
    b = b.withColumn("n", F.least(F.size("ws"), F.lit(size)))
    b = b.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(ws) - n + 1), i -> slice(ws, i, n))")).alias("w"))
    return b.groupBy("n", "w").agg(F.collect_set("item_id").alias("items")).withColumn("h", F.xxhash64("w"))


def _hits(keyed: DataFrame, benchmark: DataFrame, size: int, all_documents: bool) -> DataFrame:
    """keyed: doc_id, __text_key, ws.  A row (i, n, items) for each verified hit at word i, from 1.

    all_documents: a row with i = 0 for each document besides.
    """
    items = windows(benchmark, size)
    counted = items.groupBy("n").count().collect()  # of at most `size` rows
    small = sum(r["count"] for r in counted) <= BROADCAST_WINDOWS
    parts = []
    for n in sorted({r["n"] for r in counted if r["n"] < size} | {size}):
        first = "array(cast(null as bigint))" if all_documents and n == size else "cast(array() as array<bigint>)"
        hashed = keyed.withColumn("hs", F.expr(f"concat({first}, transform({_starts('ws', n)}, i -> xxhash64(slice(ws, i, {n}))))"))
        per = hashed.select("doc_id", _TEXT_KEY, "ws", F.posexplode("hs").alias("p", "h"))
        w = items.where(F.col("n") == n).select(F.col("h").alias("wh"), "w", "items")
        w = F.broadcast(w) if small else w
        per = per.withColumn("i", F.col("p") + (0 if first.startswith("array") else 1)).drop("p")
        per = per.withColumns({"n_words": F.when(F.col("i") == 0, F.size("ws")), "own": F.when(F.col("i") > 0, F.slice("ws", F.greatest("i", F.lit(1)), n))})
        # a broadcast join cuts out the words of hits only; a shuffle carries a window's words, never the text
        per = per.drop("ws").join(w, per["h"] == w["wh"], "left" if first.startswith("array") else "inner").where("i = 0 or own = w")
        parts.append(per.select("doc_id", _TEXT_KEY, "n_words", "i", F.lit(n).alias("n"), "items"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    # explode of one element: a projection would be merged into those above it and split the text for each word again
    return documents.select("doc_id", F.xxhash64("text").alias(_TEXT_KEY), F.explode(F.array(words(F.col("text")))).alias("ws"))


_COVERED = """aggregate(sort_array(spans), struct(0L as hit, 0 as upto), (a, s) -> struct(
    a.hit + greatest(0, s.i + s.n - 1 - greatest(a.upto, s.i - 1)) as hit, greatest(a.upto, s.i + s.n - 1) as upto)).hit"""


def report(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = _hits(_keyed(documents), benchmark, size, True)
    hit = F.col("i") > 0
    per = rows.groupBy("doc_id", _TEXT_KEY).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(~hit, 1)).alias("copies"),
        F.collect_set(F.when(hit, F.struct("i", "n"))).alias("spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("found"),
    )
    per = per.withColumn("n_hit", F.expr(_COVERED)).withColumn("ids", F.expr("array_sort(transform(array_distinct(flatten(found)), x -> cast(x as string)))"))
    per = per.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    )
    return per.drop("copy")


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents") -> DataFrame:
    """The documents without contaminated ones (remove="documents"), or with the hit words and what
    follows each of them up to the next word taken out of the text (remove="spans"); the other columns stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    hits = _hits(_keyed(documents), benchmark, size, False)
    keyed = documents.withColumn(_TEXT_KEY, F.xxhash64("text"))
    if remove == "documents":
        bad = hits.select(F.col("doc_id").alias("__id"), F.col(_TEXT_KEY).alias("__key")).distinct()
        return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(_TEXT_KEY) == F.col("__key")), "left_anti").drop(_TEXT_KEY)
    spans = hits.groupBy(F.col("doc_id").alias("__id"), F.col(_TEXT_KEY).alias("__key")).agg(F.collect_set(F.struct("i", "n")).alias("__spans"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    lead = F.regexp_extract("text", f"^{between}*", 0)
    each = F.regexp_extract_all("text", F.lit(f"({word}+{between}*)"), F.lit(1))
    kept = F.filter(each, lambda _, k: ~F.exists("__spans", lambda s: (k + 1 >= s["i"]) & (k + 1 < s["i"] + s["n"])))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(_TEXT_KEY) == F.col("__key")), "left")
    text = F.when(F.col("__spans").isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*documents.columns)
