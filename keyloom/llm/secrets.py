"""Secret scans with multipart credential linking.

Strong candidates (kinds assign, access, hex) are reported always. Weak ones (weak_secret, weak_id, endpoint) are
reported only where complementary parts lie within ``SCOPE`` code points: a weak secret beside an identifier or an
endpoint, a weak identifier beside a secret, an endpoint beside an identifier and a secret. Only built-in DataFrame
functions run. The interval join is a sweep over a document's parts by position: the farthest end of each role so
far and the nearest start still to come say whether a partner overlaps the scope, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind, role, pattern, group whose length counts, least length. The order of kinds is that of ties.
KINDS = (
    ("assign", "secret", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "id", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "secret", r"[0-9a-f]{16,}", 0, 16),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]{0,39}[0-9])(?=[a-z0-9/+]{0,39}[A-Z])(?=[A-Z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 40),
    ("weak_id", "id", r"(?i)\b(?:access_?key_?id|client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", 0, 4),
    ("endpoint", "endpoint", r"(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._:/?&=%#~@+-]{4,}", 0, 4),
)
BASE = ("assign", "access", "hex")
SCOPE = 200


def _found(text: Column, order: int, pattern: str, group: int) -> Column:
    """array<struct<kind, seq, gap, long, part>> of the leftmost non-overlapping matches, lengths in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    longs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    parts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else longs
    each = F.transform(
        longs,
        lambda m, i: F.struct(F.lit(order).alias("kind"), i.alias("seq"), F.get(gaps, i).alias("gap"), m.alias("long"), F.get(parts, i).alias("part")),
    )
    none = F.array().cast("array<struct<kind:int,seq:int,gap:int,long:int,part:int>>")
    return F.when(text.rlike(pattern), each).otherwise(none)


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id and ``spans``, array<struct<start, kind, end, name>> by start, then kind.

    docs: doc_id, text; other columns are not read. Offsets are code points, the end exclusive. Null and empty texts
    have no spans. Repeated rows get a result each, ties in start go by the order of kinds, no rows give none.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    all_found = F.concat(*[_found(F.col("text"), i, k[2], k[3]) for i, k in enumerate(KINDS)])
    parts = texts.select("row", "doc_id", F.explode_outer(all_found).alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(upto))
    placed = placed.withColumn("start", F.col("end") - F.col("long"))
    least = F.get(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind"))
    role = F.get(F.array(*[F.lit(k[1]) for k in KINDS]), F.col("kind"))
    held = placed.withColumn("good", F.col("part") >= least).withColumn("role", F.when(F.col("good"), role))
    around = Window.partitionBy("row").orderBy("start", "kind")
    back, ahead = around.rowsBetween(Window.unboundedPreceding, -1), around.rowsBetween(1, Window.unboundedFollowing)

    def near(r: str) -> Column:
        before = F.max(F.when(F.col("role") == r, F.col("end"))).over(back)
        after = F.min(F.when(F.col("role") == r, F.col("start"))).over(ahead)
        return F.coalesce(before >= F.col("start") - scope, F.lit(False)) | F.coalesce(after <= F.col("end") + scope, F.lit(False))

    near_by = {r: near(r) for r in ("secret", "id", "endpoint")}
    strong = F.col("kind") < len(BASE)
    linked = (
        F.when(F.col("kind") == 3, near_by["id"] | near_by["endpoint"])
        .when(F.col("kind") == 4, near_by["secret"])
        .when(F.col("kind") == 5, near_by["id"] & near_by["secret"])
    )
    named = F.get(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("good") & (strong | linked), F.struct("start", "kind", "end", named.alias("name")))
    out = held.select("row", "doc_id", span.alias("span"))
    return out.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")).drop("row")


def digest(found: DataFrame) -> DataFrame:
    """From ``spans``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
