"""Order MinHash of documents in Spark's own array expressions.

The k-mers of a text are its runs of ``K`` words, numbered when they recur. Each of ``SIGNATURES`` random orders
picks its ``2`` least numbered k-mers; the two, in the order they have in the text, are hashed to one entry. So
entries agree the more k-mers two texts share *in the same order*: unlike a set sketch, the fingerprint notices
when passages move, as edit distance does.

A numbered k-mer meets the orders one after the other, in ``SIGNATURES`` rounds from an order and in steps given
by its hash, each at a random time of the round. The times are its keys, so it has one in every order. Keys
are looked at up to the time by which every order has most likely met two k-mers, later ones where one has
not: a long text costs about one key for each word, and no k-mer is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
SIGNATURES = 64
REACH = 14  # keys of an order that are looked at, on average; in one text of 1,000 some order has met fewer than two
_TIME, _ROUND, _SLOT = (1 << 51) - 1, 51, 57  # a key: order, round, time in the round and, in its last bits, the k-mer
_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def _heads(sorted_keys: Column, group) -> Column:
    """Places in a sorted array at which ``group`` of a key changes."""
    return F.array_compact(
        F.transform(
            sorted_keys, lambda k, j: F.when(~group(k).eqNullSafe(group(F.get(sorted_keys, j - 1))), j)
        )
    )


def _slot(key: Column) -> Column:
    return F.shiftright(key, _SLOT)


def _points(ids: Column, cap: Column, reach: int) -> Column:
    """Keys of numbered k-mers, ascending: all rounds up to the one by which an order meets ``reach`` of them.

    Of a text with so many k-mers that a part of the first round is enough, the keys of that part.
    """
    n, enough = F.size(ids), reach * SIGNATURES
    rounds = F.least(F.ceil(F.lit(enough) / F.greatest(n, F.lit(1))), F.lit(SIGNATURES)).cast("int")

    def key(x: Column, j: Column, i: Column | None = None) -> Column:
        slot, time = F.shiftrightunsigned(x, 58), x
        if i is not None:
            step = F.shiftright(x, _ROUND).bitwiseAND(F.lit(SIGNATURES - 1)).bitwiseOR(F.lit(1))  # odd: no order twice
            slot = (slot + step * i).bitwiseAND(F.lit(SIGNATURES - 1))
            time = F.when(i == 0, x).otherwise(F.xxhash64(x, i))
        at = time.bitwiseAND(F.lit(_TIME)).bitwiseAND(-cap).bitwiseOR(j.cast("long"))
        at = at if i is None else at.bitwiseOR(F.shiftleft(i.cast("long"), _ROUND))
        return F.shiftleft(slot, _SLOT).bitwiseOR(at)

    bound = (F.lit(float(enough) * 2.0**_ROUND) / F.greatest(n, F.lit(1))).cast("long")
    part = F.filter(F.transform(ids, lambda x, j: key(x, j)), lambda k: k.bitwiseAND(F.lit(_TIME)) < bound)
    every = F.flatten(
        F.transform(F.sequence(F.lit(0), rounds - 1), lambda i: F.transform(ids, lambda x, j: key(x, j, i)))
    )
    return F.sort_array(F.when(n > enough, part).otherwise(every))


def with_signature(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the column ``out``: SIGNATURES entries of 16 bits, none for a text without words."""
    names = [f"{out}_{c}" for c in ("words", "mers", "cap", "places", "runs", "ids", "keys", "firsts", "more")]
    words, mers, cap, places, runs, ids, keys, firsts, more = (F.col(c) for c in names)

    def put(**columns: Column) -> None:
        nonlocal rows
        for name, value in columns.items():
            rows = rows.withColumn(f"{out}_{name}", value)

    put(words=F.array_remove(F.split(F.coalesce(text, F.lit("")), _WHITE), ""))
    many = F.greatest(F.size(words) - (K - 1), F.least(F.size(words), F.lit(1)))
    put(
        mers=F.transform(
            F.slice(words, F.lit(1), many),
            lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, K))),
        ),
        # A power of two above the number of k-mers: a place fits in the bits below.
        cap=F.coalesce(F.pow(F.lit(2.0), F.floor(F.log2(F.size(mers) + 1)) + 1).cast("long"), F.lit(2).cast("long")),
        # Places of the k-mers, equal ones side by side in text order.
        places=F.sort_array(F.transform(mers, lambda h, i: h.bitwiseAND(-cap).bitwiseOR(i.cast("long")))),
        runs=_heads(places, lambda k: k.bitwiseAND(-cap)),
    )

    def place(j: Column) -> Column:
        return F.get(places, j.cast("int")).bitwiseAND(cap - 1).cast("int")

    def numbered(begin: Column, run: Column) -> Column:
        """Each occurrence of a k-mer, hashed with its number."""
        times = F.coalesce(F.get(runs, run + 1), F.size(places)) - begin
        mer = F.get(mers, place(begin))
        several = F.transform(F.sequence(F.lit(1), times), lambda m: F.xxhash64(mer, m))
        return F.when(times == 1, F.array(F.xxhash64(mer, F.lit(1)))).otherwise(several)

    put(ids=F.flatten(F.transform(runs, numbered)), keys=_points(ids, cap, REACH), firsts=_heads(keys, _slot))
    lone = F.exists(firsts, lambda f: ~_slot(F.get(keys, f)).eqNullSafe(_slot(F.get(keys, f + 1))))
    put(
        more=(F.size(ids) > 1) & ((F.size(firsts) < SIGNATURES) | lone),
        keys=F.when(more, _points(ids, cap, 8 * REACH)).otherwise(keys),
        firsts=F.when(more, _heads(keys, _slot)).otherwise(firsts),
    )

    def entry(first: Column) -> Column:
        one, two = (F.get(keys, f).bitwiseAND(cap - 1).cast("int") for f in (first, first + 1))
        both = F.when(place(one) < place(two), F.hash(F.get(ids, one), F.get(ids, two)))
        both = both.otherwise(F.hash(F.get(ids, two), F.get(ids, one)))
        return F.when(F.size(ids) == 1, F.hash(F.get(ids, one))).otherwise(both).bitwiseAND(F.lit(0xFFFF))

    signature = F.when(F.size(ids) > 0, F.transform(firsts, entry)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(out, signature).drop(*names)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; texts without words are alike."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SIGNATURES - 1)), lambda p: F.get(a, p) == F.get(b, p)))
    one = (F.size(a) == 0).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), one * (F.size(b) == 0).cast("double")).otherwise(same / SIGNATURES)


def as_text(signature: Column) -> Column:
    """Four hex digits for each entry."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.substring(F.hex(x + 0x10000), 2, 4)), ""))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; null texts count as empty, whose fingerprint is the empty string."""
    rows = with_signature(docs.drop("fingerprint"), text, "_signature")
    return rows.withColumn("fingerprint", as_text(F.col("_signature"))).drop("_signature")


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Ids that cut the rows into about ``n`` even ranges."""
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    found = ids.agg(F.percentile_approx("id", shares, F.lit(10 * n)).alias("x")).first()[0] if n > 1 else None
    return sorted(set(found or []))


def _range(bounds: list[int]) -> Column:
    """Number of bounds up to the id, by coarse and then fine ones."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    fine = F.array(*(F.array(*(F.lit(x) for x in g)) for g in [[], *groups]))
    coarse = F.size(F.filter(heads, lambda b: b <= F.col("id")))
    inner = F.size(F.filter(F.get(fine, coarse), lambda b: b <= F.col("id")))
    return F.greatest(coarse - 1, F.lit(0)) * step + inner


def with_next(rows: DataFrame, columns: list[str], prepare) -> DataFrame:
    """``prepare`` of ``rows`` (id, text and others) with ``next_<c>`` of the row that follows by descending id.

    After the last row comes the first. Rows are dealt by ranges of ids; the first row of each range is
    copied to the end of the range before it, and rows and copies are prepared together.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("range", _range(_bounds(rows.select("id"), n)))
    firsts = rows.groupBy("range").agg(F.max("id").alias("id")).orderBy(F.desc("range")).collect()
    firsts = [(r["range"], r["id"]) for r in firsts]
    if not firsts:
        return prepare(rows.drop("range")).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    moved = spark.createDataFrame(
        [(own, at, before) for (own, at), (before, _) in zip(firsts, [firsts[-1], *firsts[:-1]])],
        "range int, id long, before int",
    )
    copies = rows.join(F.broadcast(moved), ["range", "id"]).withColumn("range", F.col("before")).drop("before")
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    order = Window.partitionBy("range").orderBy("copy", F.desc("id"), "text")
    both = prepare(both).select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return both.filter("NOT copy").drop("copy", "range")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, and of the text whose second half is the begin of the next document.

    ``doc_id``, ``n_chars``, ``edited`` (the text), ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    Next is the order of descending doc_id (equal ids by text, rows without id at the end), after the last
    the first. Null texts are empty.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = with_next(rows, ["text", "signature"], lambda df: with_signature(df, "text", "signature"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    )
    rows = rows.drop("text", "next_text")
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
