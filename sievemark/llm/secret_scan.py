"""Secrets by corpus-wide ownership, in DataFrame expressions.

Base patterns give spans that always stay. Wider patterns (private keys, vendor tokens, long mixed
strings) give further candidates. The hash of every candidate's value is counted over the distinct repositories and
the distinct owners that hold it: what many owners share, or many repositories of more than one owner, is a copied
example; what is specific to an owner looks live and is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native
from .common import BROADCAST_ROWS, materialize

#: The base patterns.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
#: A private key reaches to its first END line, to the next BEGIN line where that comes first (a key cut off), or else over its header line alone.
WIDER = {
    "private_key": r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*+(?<=PRIVATE KEY)-----)?+",
    "vendor_token": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "mixed": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+",
}
KINDS = [*BASE, *WIDER]
#: A value of so many distinct owners is a copied example, and so is one of two owners and so many distinct repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 5, 20


def _value(s: Column) -> Column:
    """What identifies a candidate: the assigned value, or the text."""
    assigned = F.regexp_extract(s["text"], r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(.*)$", 1)
    return F.when(s["kind"] == "assign", assigned).otherwise(s["text"])


def candidates(texts: DataFrame) -> DataFrame:
    """texts (column text, and others) with base and wider instead of text: arrays of struct(kind, start, end, value: hash).

    Wider spans that touch a base span are left out, private keys only within one.
    """
    text, keep = F.col("clean"), [c for c in texts.columns if c != "text"]
    plain = texts.select(*keep, native.clean(F.col("text")).alias("clean"))
    needs = {"access": text.contains("AKIA"), "private_key": text.contains("PRIVATE KEY"), "vendor_token": text.rlike("gh[pousr]_|xox[abprs]-|sk-|eyJ"), "mixed": text.rlike("[A-Za-z0-9+/_=-]{24}")}
    found = plain.select("*", *(native.find(text, k, p, needs.get(k)).alias(f"found_{k}") for k, p in (BASE | WIDER).items()))
    enough = {"assign": lambda s: F.length(_value(s)) >= 12, "access": lambda s: F.length(s["text"]) >= 18, "mixed": lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[a-z]") & s["text"].rlike("[A-Z]")}
    spans = lambda k: F.transform(F.filter(f"found_{k}", enough.get(k, lambda s: F.lit(True))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(_value(s)).alias("value")))
    found = found.select(*keep, F.concat(*map(spans, BASE)).alias("base"), F.concat(*map(spans, WIDER)).alias("wider"))
    touches = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & ((s["kind"] != "private_key") | ((b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return found.withColumn("wider", native.apart(F.col("wider"), F.col("base"), touches))


def ownership(held: DataFrame) -> DataFrame:
    """value, owners and repositories over rows (value, owner, repository): a repository is one of its owner.

    Counted in steps, so that a value that a third of all rows hold never meets in one group before it is small.
    """
    by_owner = held.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def is_example(owners: int, repositories: int) -> Column:
    """Whether the counts of ownership() are those of a copied example."""
    return (F.col("owners") >= owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= repositories))


def _judged(docs: DataFrame, keep: list[str], id_col: str, text_col: str, owner_col: str, repository_col: str | None, limits: tuple[int, int]) -> DataFrame:
    """Per row of docs: doc (a struct of the columns keep), base and added (arrays of struct(kind, start, end)), n_live, n_example."""
    row = F.monotonically_increasing_id()
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    repository = named(repository_col or id_col) if repository_col or id_col in docs.columns else row.cast("string")
    ready = docs.select(F.struct(*map(F.col, keep)).alias("doc"), row.alias("row"), named(owner_col).alias("owner"), repository.alias("repository"), F.col(text_col).cast("string").alias("text"))
    found = materialize(candidates(ready))
    some = F.size("base") + F.size("wider") > 0
    each = found.filter(some).select("row", "owner", "repository", F.explode(F.concat("base", "wider")).alias("s")).select("row", "owner", "repository", "s.*")
    examples = materialize(ownership(each).filter(is_example(*limits)).select("value", F.lit(True).alias("example")))
    few = examples.count() <= BROADCAST_ROWS
    judged = each.join(F.broadcast(examples) if few else examples, "value", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    added = F.collect_list(F.when(F.col("kind").isin(*WIDER) & ~F.col("example"), F.struct("kind", "start", "end")))
    per_row = judged.groupBy("row").agg(F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"), added.alias("added"))
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    hit = found.filter(some).join(per_row, "row").select("doc", bare.alias("base"), "added", "n_live", "n_example")
    none, zero = F.array().cast("array<struct<kind: string, start: int, end: int>>"), F.lit(0).cast("long")
    return hit.unionByName(found.filter(~some).select("doc", none.alias("base"), none.alias("added"), zero.alias("n_live"), zero.alias("n_example")))


def find_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """Per row of docs: id_col, base and added (arrays of struct(kind, start, end)), n_live and n_example (spans by ownership).

    Places are code points, ends exclusive. A value held by example_owners distinct owners, or by two and by
    example_repositories distinct repositories, is a copied example. Without repository_col each document (id_col) is a
    repository of its owner; a null owner or repository counts as one of its own. Base spans stay whatever their owners;
    wider candidates are added where they look live. Null or empty texts have no spans. Null ids, repeated rows (copies
    of one repository) and other columns, whatever their names, are allowed: one row out for each row; an empty table
    gives an empty result. Whole texts are read.
    """
    found = _judged(docs, [id_col], id_col, text_col, owner_col, repository_col, (example_owners, example_repositories))
    return found.select("doc.*", "base", "added", "n_live", "n_example")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """find_secrets() as counts of base spans by kind, base_sha256 and spans (kind:start:end by start, then kind), n_live, n_example."""
    found = find_secrets(docs, id_col=id_col, text_col=text_col, owner_col=owner_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, BASE), F.sha2(native.written(native.by_start(F.col("base"), KINDS)), 256).alias("base_sha256"), native.written(native.by_start(F.concat("base", "added"), KINDS)).alias("spans"), "n_live", "n_example")


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """docs, all columns, with every span of find_secrets() in text_col written over by mask (overlapping spans as one).

    Texts without spans, empty and null ones stay as they are, and so does every other column, whatever its name. Null
    ids and repeated rows give a row each; an empty table gives an empty result.
    """
    found = _judged(docs, docs.columns, id_col, text_col, owner_col, repository_col, (EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES))
    text, spans = F.col("doc")[text_col].cast("string"), native.by_start(F.concat("base", "added"), KINDS)
    written = F.when(F.size("base") + F.size("added") > 0, native.let(spans, lambda s: native.masked(text, s, mask))).otherwise(text)
    return found.select(*((written.cast(f.dataType) if f.name == text_col else F.col("doc")[f.name]).alias(f.name) for f in docs.schema.fields))
