"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read without its white space. A k-gram of 4 k signs begins at every sign (code point); its hash rolls on from
those of its two halves, which are halves of its neighbours too. Each window of 4 w neighbouring k-grams keeps its
smallest hash, the rightmost of equal ones, and the kept hashes with their positions are the fingerprint. Any run of
4 (w + k) - 1 signs that two texts share, at any place, leaves a common hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, shuffle_partitions

#: Signs that k and window count in.
UNIT = 4
#: A hash and a position share a long: 32 bits of hash, then 31 bits that fall with the position.
LOW = (1 << 31) - 1


def _doubled(rows: DataFrame, columns: list[str], length: int, join) -> DataFrame:
    """Over arrays, join of each `length` neighbours (a power of two), by joins of joined halves.

    Each step is a projection of its own, as an array stands in it twice and must not be computed twice.
    """
    step = 1
    while step < length:
        rows = rows.withColumns({c: F.zip_with(F.col(c), F.slice(c, step + 1, 1 << 30), join) for c in columns})
        step *= 2
    return rows


def with_keys(rows: DataFrame, texts: dict[str, str], k: int = 4, window: int = 8) -> DataFrame:
    """Adds array<long> columns, texts naming each one's text column: (hash << 31) + (2^31 - 1 - position) for each kept
    k-gram, in order of first choice. k and window are powers of two, in units of four signs."""
    out, signs, reach = list(texts), UNIT * k, UNIT * window
    rows = rows.withColumns({c: F.regexp_replace(t, r"(?U)\s+", "") for c, t in texts.items()})
    # A text shorter than a k-gram is one; an empty one has none.
    rows = rows.withColumns({c: F.when(F.char_length(c) >= signs, F.transform(F.split(F.col(c), F.lit("")), lambda p: F.xxhash64(p))).when(F.char_length(c) > 0, F.array(F.xxhash64(c))).otherwise(F.array().cast("array<bigint>")) for c in out})
    key = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(LOW) - i)
    step = 1
    while step * 2 < signs:
        both = {c: F.zip_with(F.slice(c, 1, F.size(c) - step), F.slice(c, step + 1, 1 << 30), lambda a, b: F.xxhash64(a, b)) for c in out}
        rows = rows.withColumns({c: F.when(F.size(c) > step, x).otherwise(F.col(c)) for c, x in both.items()})
        step *= 2
    # The last joins go along with the positions: each walk over the signs is dear.
    last = lambda c, step: F.transform(F.slice(c, 1, F.size(c) - step), lambda h, i: key(F.xxhash64(h, F.get(F.col(c), i + step)), i))
    both = {c: last(c, step) for c in out}
    rows = rows.withColumns({c: F.when(F.size(c) > step, x).otherwise(F.transform(c, key)) for c, x in both.items()})
    # zip_with pads with null, which least ignores: the tails are cut off after it.
    rows = _doubled(rows, out, reach, lambda a, b: F.least(a, b))
    return rows.withColumns({c: F.array_distinct(F.slice(c, 1, F.greatest(F.size(c) - (reach - 1), F.lit(1)))) for c in out})


def fingerprint_text(keys: Column) -> Column:
    """'hash:position' of the kept k-grams, hashes in hexadecimal, joined by spaces."""
    return F.array_join(F.transform(keys, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 31))), F.lit(":"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays' distinct values; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise((F.size(a) + F.size(b)) / F.greatest(both, F.lit(1)) - 1.0)


def hashes_of(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda x: F.shiftrightunsigned(x, 31)))


def with_next(rows: DataFrame, columns: list[str], prepare=None, bucket_rows: int = 2000, coarse: int = 512, fine: int = 128) -> DataFrame:
    """Each row, after `prepare` (which may add columns to it), with `next_<column>` of the row that follows it by descending doc_id; after the last, the first.

    Rows are dealt into ranges of doc_id, about one for bucket_rows rows: between quantiles, at most `coarse`, and where
    these don't do, into up to `fine` equal parts of each. A range ends with a copy of the row that heads the range after
    it, so one exchange serves all; the ranges' heads are a table of at most coarse * fine + 1 rows. Null ids come last;
    rows of one id stand in the order of their texts.
    """
    total, low, high, bounds = rows.select("doc_id").agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 20000)).first()
    wanted = max(1, total // bucket_rows + 1, 2 * shuffle_partitions(rows.sparkSession) if total > 10_000 else 1)
    n, parts = min(coarse, wanted), min(fine, -(-wanted // coarse))
    bounds = sorted({b for i, b in enumerate(bounds or []) if (i + 1) * n // coarse > i * n // coarse and b < high})
    place = F.lit(-1)
    if high is not None:
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
        begin, end = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), at + 1) for xs in ([low, *bounds], [*bounds, high]))
        share = (F.col("doc_id").cast("double") - begin) / F.greatest(end - begin, F.lit(1.0))
        inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts).cast("int")))
        place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * parts + inner)
    dealt = rows.withColumn("range", place.cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    # The head of each range goes to the end of the range above it; that of the highest to the end of the lowest.
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("head"))
    above = F.lead("range").over(Window.orderBy("range"))
    heads = heads.withColumn("above", above).crossJoin(heads.agg(F.min("range").alias("lowest"))).select(F.col("range").alias("of"), "head", F.coalesce("above", "lowest").alias("goes"))
    kept = dealt.withColumn("doubled", F.lit(False))
    ends = dealt.join(F.broadcast(heads), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    ends = ends.select(*rows.columns, F.col("goes").alias("range"), F.lit(True).alias("doubled"))
    w = Window.partitionBy("range").orderBy("doubled", *order)
    prepare = prepare or (lambda x: x)
    both = prepare(kept.unionByName(ends).repartition("range")).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return both.where(~F.col("doubled")).drop("range", "doubled")


def fingerprints(docs: DataFrame, k: int = 4, window: int = 8) -> DataFrame:
    """doc_id, fingerprint for every row; empty texts and white space alone have the empty fingerprint."""
    return with_keys(docs_of(docs), {"own": "text"}, k, window).select("doc_id", fingerprint_text(F.col("own")).alias("fingerprint"))


def _chosen_within(keys: Column, signs: Column, gram: int, reach: int) -> Column:
    """Of a text's kept keys those that a window inside its first `signs` signs keeps.

    Kept keys stand in the order of their first windows: a key that isn't above the one before it is kept as soon as a
    window reaches it, any other once the one before it has fallen out. Texts without a whole window must not ask.
    """
    place = lambda x: F.lit(LOW) - x.bitwiseAND(F.lit(LOW))
    hashed = lambda x: F.shiftrightunsigned(x, 31)

    def inside(x: Column, p: Column) -> Column:
        last = F.get(keys, p - 1)
        first = F.when(p == 0, F.lit(0)).when(hashed(x) <= hashed(last), place(x) - (reach - 1)).otherwise(place(last) + 1)
        return first + (gram + reach - 1) <= signs

    return F.filter(keys, inside)


def with_joined_keys(rows: DataFrame, k: int = 4, window: int = 8) -> DataFrame:
    """Adds `new`, the keys of the text made of head and tail, which begin the texts with the keys own and next_own.

    Windows inside the head keep what they keep in its text, those inside the tail what they keep in theirs, further on;
    only windows with signs of both are hashed anew. The result is with_keys() of the joined text.
    """
    gram, reach = UNIT * k, UNIT * window
    span = gram + reach - 1
    rows = rows.withColumns({f"{c}_signs": F.regexp_replace(c, r"(?U)\s+", "") for c in ("head", "tail")})
    rows = rows.withColumns({f"{c}_n": F.char_length(f"{c}_signs") for c in ("head", "tail")})
    a, b = F.col("head_n"), F.col("tail_n")
    # Less than a whole window is one window, all of it.
    met = (a + b < span) | ((a > 0) & (b > 0))
    border = F.when(met, F.concat(F.substring("head_signs", 1 - span, span - 1), F.substring("tail_signs", 1, span - 1))).otherwise("")
    rows = with_keys(rows.withColumn("border", border).drop("head_signs", "tail_signs"), {"met": "border"}, k, window)
    before = _chosen_within(F.col("own"), a, gram, reach)
    after = _chosen_within(F.col("next_own"), b, gram, reach)
    between = F.transform("met", lambda x: x - F.greatest(a - (span - 1), F.lit(0)))
    joined = F.array_distinct(F.concat(before, between, F.transform(after, lambda x: x - a)))
    return rows.withColumn("new", joined).drop("met", "border", "head_n", "tail_n")


def edited_fingerprints(docs: DataFrame, k: int = 4, window: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null and empty texts: no signs, an empty fingerprint, an empty edited text. A text with fewer signs than a k-gram
    is one k-gram. A lone row is its own next. Repeated rows follow each other; an empty table gives an
    empty result; other columns are ignored. Positions are numbers of signs that are not white space and go up to 2^31 - 1.
    """
    rows = with_next(docs_of(docs), ["text", "own"], lambda x: with_keys(x, {"own": "text"}, k, window))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumns({"head": F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half")), "tail": F.substring("next_text", F.lit(1), F.col("half"))})
    rows = with_joined_keys(rows.drop("text", "next_text").withColumn("edited", F.concat("head", "tail")), k, window).drop("head", "tail")
    rows = rows.withColumns({f"{c}_hashes": hashes_of(F.col(c)) for c in ("own", "new", "next_own")})
    near = {f"near_{b}": likeness(F.col("own_hashes"), F.col(f"{a}_hashes")) for a, b in (("new", "edited"), ("next_own", "next"))}
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("new")).alias("edited_fingerprint"), *[x.alias(c) for c, x in near.items()])
