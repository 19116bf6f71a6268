"""Document fingerprints from closed syncmers, in DataFrame expressions.

A text's tokens are its words; signs of scripts that are written without spaces, and those of runs of more than
TOKEN_CHARS signs, are tokens one by one, so that no token's edge depends on what stands far before it. A k-mer of K
tokens is chosen if, of the S-token substrings inside it, the one with the least hash lies at an edge; the choice
depends on the k-mer alone, so that a passage keeps its anchors wherever it stands. The fingerprint holds anchors
with their positions: those of the least hashes, SKETCH or one in SHARE, whichever is more. Two fingerprints are
matched by position: a common anchor counts where it stands at the same place in both, or where another common
anchor is moved by the same distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .native import let

K, S = 4, 2
TOKEN_CHARS = 24
SKETCH, SHARE = 64, 16

#: Rows of one stretch of documents in the order of their ids: few while they make FEW_STRETCHES at most, then more, but not over MOST_ROWS.
STRETCH_ROWS, FEW_STRETCHES, MOST_ROWS = 2_000, 2_000, 100_000

#: The blocks of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, kana, ideographs).
_SIGNS = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_RUN = rf"[^\x20\x09-\x0D{_SIGNS}]"


def tokens(text: Column) -> Column:
    """Runs without white space and without signs of unspaced scripts, whole up to TOKEN_CHARS; of longer ones the last TOKEN_CHARS signs are one token; other signs one by one."""
    cut = F.regexp_extract_all(text, F.lit(rf"({_RUN}{{1,{TOKEN_CHARS}}}+(?!{_RUN})|[^\x20\x09-\x0D])"), F.lit(1))
    # Most texts have neither such signs nor long runs: there the runs themselves are the tokens, and cutting is cheaper.
    long = lambda w: (F.octet_length(w) > TOKEN_CHARS) & (F.length(w) > TOKEN_CHARS)
    plain = let(F.split(text, r"[\x20\x09-\x0D]+"), lambda ws: F.when(F.exists(ws, long), cut).otherwise(F.filter(ws, lambda w: w != "")))
    return F.when(text.rlike(f"[{_SIGNS}]"), cut).otherwise(plain)


def anchors(text: Column) -> Column:
    """The chosen k-mers: array of struct(pos: index of the first token, hash). Fewer than K tokens: each token is an anchor."""

    def syncmers(w: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(w) - (S - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(S))))
        edge = lambda s, i: F.least(F.element_at(s, i), F.element_at(s, i + K - S)) <= F.array_min(F.slice(s, i + 1, F.lit(K - S - 1)))
        chosen = lambda s: F.filter(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: edge(s, i))
        hashed = lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(*(F.element_at(w, i + j) for j in range(K))).alias("hash"))
        return let(inner, lambda s: F.transform(chosen(s), hashed))

    few = lambda w: F.transform(w, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, F.lit(K)).alias("hash")))
    hashes = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))
    return let(hashes, lambda w: F.when(F.size(w) >= K, syncmers(w)).otherwise(few(w)))


def sketch(text: Column) -> Column:
    """The anchors of the least distinct hashes with their first positions, by hash: array of struct(hash, pos); empty for a text without words."""
    hashes = lambda a: F.sort_array(F.array_distinct(F.transform(a, lambda x: x["hash"])))
    last = lambda h: F.get(h, F.least(F.greatest(F.lit(SKETCH), F.floor(F.size(h) / SHARE).cast("int")), F.size(h)) - 1)
    upto = lambda a, bound: F.sort_array(F.transform(F.filter(a, lambda x: x["hash"] <= bound), lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"))))
    firsts = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["hash"] != x["hash"]))
    return let(anchors(text), lambda a: let(let(hashes(a), last), lambda bound: let(upto(a, bound), firsts)))


def written(kept: Column) -> Column:
    """A sketch as text: hash.position of each anchor, the hash in hexadecimal digits."""
    return F.concat_ws(" ", F.transform(kept, lambda x: F.concat_ws(".", F.lower(F.hex(x["hash"])), x["pos"].cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the anchors of both texts that match by position. Two empty sketches: 1.

    Of the hashes in either sketch the least ones are looked at, as many as the smaller sketch has (a sketch of fewer
    than SKETCH is whole and bounds nothing).
    """
    bare = lambda x: F.transform(x, lambda y: y["hash"])
    room = lambda x: F.when(F.size(x) >= SKETCH, F.size(x)).otherwise(F.lit(2**31 - 1))
    union = F.slice(F.sort_array(F.array_union(bare(a), bare(b))), F.lit(1), F.least(room(a), room(b)))
    side = lambda x, n, bound: F.transform(F.filter(x, lambda y: y["hash"] <= bound), lambda y: F.struct(y["hash"].alias("hash"), F.lit(n).alias("side"), y["pos"].alias("pos")))
    both = lambda bound: F.sort_array(F.concat(side(a, 0, bound), side(b, 1, bound)))
    moved = lambda m: F.sort_array(F.filter(F.transform(m, lambda x, i: F.when(F.get(m, i - 1)["hash"] == x["hash"], x["pos"] - F.get(m, i - 1)["pos"])), lambda d: d.isNotNull()))
    agree = lambda d: F.size(F.filter(d, lambda x, i: (x == 0) | F.coalesce(F.get(d, i - 1) == x, F.lit(False)) | F.coalesce(F.get(d, i + 1) == x, F.lit(False))))
    matched = lambda u: let(both(F.element_at(u, -1)), lambda m: let(moved(m), agree))
    return let(union, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(matched(u) / F.size(u)))


def stretches(rows: int) -> int:
    """How many stretches so many rows are dealt to."""
    return max(1, min(FEW_STRETCHES, rows // STRETCH_ROWS), -(-rows // MOST_ROWS))


def _bounds(ids: DataFrame) -> list:
    """The least id of each stretch, ascending."""
    # Written first: the optimiser would drop the ranges below an aggregate.
    dealt = materialize(ids.repartitionByRange(stretches(ids.count()), "doc_id").withColumn("stretch", F.spark_partition_id()))
    return sorted(r["least"] for r in dealt.groupBy("stretch").agg(F.min("doc_id").alias("least")).collect())  # one row a stretch


def _place(bounds: list) -> Column:
    """The number of the stretch of each id: searched in two steps, so that the work is twice the root of their number."""
    wide = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    upto = lambda items: F.size(F.filter(items, lambda b: b <= F.col("doc_id")))
    listed = lambda items: F.array(*map(F.lit, items))
    inside = lambda i: i * wide + upto(F.get(F.array(*map(listed, parts)), i)) - 1
    return let(upto(listed([p[0] for p in parts])) - 1, inside)


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and what else it has) with next: a struct of the row after it in ascending doc_id (after the last: the first).

    The ids are cut into stretches of like size; a stretch also gets a copy of the next one's first row, so that no
    task sees all rows. Rows of one id follow each other by text. A row without id has no next (null).
    """
    fields = docs.columns
    known = docs.filter("doc_id IS NOT NULL")
    bounds = _bounds(known.select("doc_id"))
    if not bounds:
        return docs.withColumn("next", F.lit(None).cast(docs.schema))
    dealt = known.withColumn("stretch", _place(bounds))
    heads = dealt.filter(F.col("doc_id").isin(bounds)).groupBy("doc_id", "stretch").agg(F.min(F.struct("text", *(F.col(c) for c in fields if c not in ("doc_id", "text")))).alias("h"))
    ghosts = heads.select("doc_id", F.pmod(F.col("stretch") - 1, F.lit(len(bounds))).alias("stretch"), "h.*").select(*fields, "stretch", F.lit(True).alias("ghost"))
    dealt = dealt.select(*fields, "stretch", F.lit(False).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("stretch").orderBy("ghost", "doc_id", "text")
    chained = dealt.withColumn("next", F.lead(F.struct(*fields)).over(order)).filter("NOT ghost").select(*fields, "next")
    return chained.unionByName(docs.filter("doc_id IS NULL").withColumn("next", F.lit(None).cast(chained.schema["next"].dataType)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, anchors (array of struct(pos, hash)), fingerprint (hash.position of the kept anchors, joined by spaces).

    Null or empty texts have no anchors and an empty fingerprint. Null ids, repeated rows and other columns are
    allowed: one row out for each row; an empty table gives an empty result. Whole texts are read.
    """
    return docs.select("doc_id", anchors(F.col("text")).alias("anchors"), written(sketch(F.col("text"))).alias("fingerprint"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    row's text in ascending doc_id (after the last: the first). Rows of one id follow each other by text; a row
    without id has an empty next text. Null text is empty.
    """
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = beside_next(given.withColumn("own", sketch(F.col("text"))))
    n = F.char_length("text").cast("long")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - quarter), F.coalesce(F.substring("next.text", F.lit(1), quarter), F.lit("")))
    none = F.array().cast("array<struct<hash: bigint, pos: int>>")
    found = paired.select("doc_id", n.alias("n_chars"), "own", F.coalesce("next.own", none).alias("next_own"), edited.alias("edited"))
    found = found.withColumn("edited_own", sketch(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
