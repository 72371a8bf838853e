"""Secrets, separated by how widely their values are owned. DataFrame operations only.

Base patterns find assignments, access keys and hex strings. The corpus-wide step
hashes every candidate value and counts the distinct owners and repositories
that hold it: a value of many owners is a copied example, a live-looking value of
one owner is a credential. Bare credential-shaped words count as candidates too
and become spans of kind ``bare`` only where that count shows them as live.

In ``documents`` the owner is the source and a document is a repository of its
owner.

Scale: one scan of the text writes a table of candidates (no raw values; the
texts only where they are masked next). Frequencies are counted in two steps, first per value, owner and
repository, then per value, both with map-side aggregation, so a value copied
into a third of all rows is no hot task. Verdicts return by joins on the value's
hash, where Spark may split a frequent one, and on row numbers of the written
table.

Defined cases: a null text is empty and has no spans; a null owner or repository
counts as one of its own; repeated rows are separate rows, and one repository;
an empty table gives an empty one; extra columns are ignored (``redact`` carries
them). Matching is leftmost and non-overlapping per kind; offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import materialize

# The patterns of the three base kinds, in order, with the group that
# holds the value and the least length of that value.
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
BARE = ("bare", r"[A-Za-z0-9_-]+", 0, 20)

#: A value of so many owners is an example; of so few, its owner's.
WIDE, OWN = 3, 1
#: Values that only show where a secret would stand, and the fewest distinct characters of a live one.
PLACEHOLDER, VARIED = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|0123456|1234567|abcdef[^0-9a-f]", 8


def _pattern(pattern: str, group: int, least: int) -> str:
    """Where the value is a maximal run, the pattern itself can skip the shorter ones."""
    if group or not pattern.endswith("]+"):
        return pattern
    return f"{pattern[:-1]}{{{least - len(pattern.split('[')[0])},}}"


#: Matches that are put together at once, and code points of a text's parts.
BLOCK, PART = 256, 4096


def _spans(hits: Column, values: Column, before: Column, least: int) -> Column:
    """Spans of all matches: array of (start, end, value), values of at least ``least`` characters.

    ``before`` holds the texts between the matches: they and the matches give the
    offsets. Matches are added up BLOCK by BLOCK, so the work grows with their
    number and not with its square.
    """
    rows = F.slice(F.arrays_zip(hits.alias("hit"), values.alias("value"), before.alias("before")), 1, F.size(hits))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["before"])
        end = begin + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    def add_block(done: Column, block: Column) -> Column:
        at = F.element_at(done, -1)["at"]
        return F.concat(done, F.array(F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)))

    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("spans")))
    blocks = F.transform(F.array(rows), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, BLOCK)))
    found = F.aggregate(F.element_at(blocks, 1), first, add_block, lambda done: F.flatten(F.transform(done, lambda x: x["spans"])))
    return F.when(F.size(hits) > 0, F.filter(found, lambda s: F.char_length(s["value"]) >= least)).otherwise(none)


def _looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return ~value.rlike(PLACEHOLDER) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= VARIED)


def _with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and spans: array of (start, rank, kind, end, hash, live), by start and kind."""
    text, kinds = F.col("text"), (*BASE, BARE)
    rules = {kind: (F.lit(_pattern(rx, group, least)), group) for kind, rx, group, least in kinds}
    # each as a column of its own: an expression inside a higher-order function is run anew at every mention
    rows = rows.withColumns({f"hit_{k}": F.regexp_extract_all(text, rx, F.lit(0)) for k, (rx, _) in rules.items()})
    some = {k: F.size(f"hit_{k}") > 0 for k in rules}
    rows = rows.withColumns(
        {f"value_{k}": F.when(some[k], F.regexp_extract_all(text, rx, F.lit(group))) if group else F.col(f"hit_{k}") for k, (rx, group) in rules.items()}
        | {f"gap_{k}": F.when(some[k], F.split(text, rx, -1)) for k, (rx, _) in rules.items()}
    )
    rows = rows.withColumns({f"spans_{kind}": _spans(F.col(f"hit_{kind}"), F.col(f"value_{kind}"), F.col(f"gap_{kind}"), least) for kind, _, _, least in kinds})

    def shape(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), _looks_live(s["value"]).alias("live"))

    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.transform(f"spans_{kind}", shape(rank, kind)) for rank, (kind, *_) in enumerate(BASE)])))
    bare = F.filter("spans_bare", lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]") & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", F.transform(bare, shape(len(BASE), BARE[0])))))
    return rows.drop("base", *[f"{x}_{kind}" for kind, *_ in kinds for x in ("hit", "value", "gap", "spans")])


def ownership(candidates: DataFrame, wide: int = WIDE, own: int = OWN) -> DataFrame:
    """Per value hash: hash, n_owners, n_repos, verdict of ``candidates`` (hash, owner, repo, live).

    Verdicts: ``example`` (``wide`` owners or more, or not live-looking), ``live``
    (``own`` owners at most), else ``shared``.
    """
    each = candidates.groupBy("hash", "owner", "repo").agg(F.max("live").alias("live"))
    per_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("live").alias("live"))
    per = per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("live").alias("live"))
    verdict = F.when((F.col("n_owners") >= wide) | ~F.col("live"), "example").when(F.col("n_owners") <= own, "live").otherwise("shared")
    return per.select("hash", "n_owners", "n_repos", verdict.alias("verdict"))


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Per row: doc_id and spans, an array of (start, rank, kind, end, hash, verdict, n_owners, n_repos).

    Base spans always stay; a bare one only if its verdict is ``live``.
    """
    slim = docs.select(docs["doc_id"].alias("doc_id"), docs[owner].cast("string").alias("owner"), docs[repo].cast("string").alias("repo"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = materialize(_with_spans(slim).select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", "spans"), "secrets")
    each = found.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    verdicts = ownership(each.select("hash", "owner", "repo", "live"))
    judged = each.join(verdicts, "hash").where("rank < 3 or verdict = 'live'")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "hash", "verdict", "n_owners", "n_repos"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,hash:string,verdict:string,n_owners:bigint,n_repos:bigint>>)")
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, and how many spans have which verdict."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(what, value):
        return F.size(F.filter("spans", lambda s: s[what] == value)).cast("long")

    return found.select(
        "doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(text(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "shared", "example")],
    )


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live or shared secret's span replaced by ``mark`` (n_chars follows); same columns.

    The patterns run once a text: rows and their spans are written, and read again
    for the verdicts. Only rows with a span to mask take part in the join that
    brings the cuts back; all other texts pass without a shuffle. Spans that
    overlap are one cut. Null and empty texts stay as they are; equal rows are cut alike.
    """
    names = docs.columns
    doc = F.struct(*[docs[f"`{c}`"].alias(c) for c in names]).alias("doc")
    rows = docs.select(doc, docs[owner].cast("string").alias("owner"), docs[repo].cast("string").alias("repo"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = materialize(_with_spans(rows).select(F.monotonically_increasing_id().alias("row"), "doc", "owner", "repo", "spans"), "spans")
    some = rows.where(F.size("spans") > 0)
    each = some.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    # written, so that Spark may split the rows of a frequent value
    masked = materialize(ownership(each).where("verdict != 'example'").select(F.col("hash").alias("masked")), "masked")
    hit = each.select("row", "start", "end", "hash").join(masked, F.col("hash") == F.col("masked"), "left_semi")
    # a span that starts before the largest end so far belongs to the cut before
    before = Window.partitionBy("row").orderBy("start", "end")
    hit = hit.withColumn("reached", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    hit = hit.withColumn("cut", F.sum((F.coalesce("reached", F.lit(0)) <= F.col("start")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    hit = hit.groupBy("row", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = hit.groupBy(F.col("row").alias("hit_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cut = some.select("row", "doc").join(cuts, F.col("row") == F.col("hit_row"), "left")
    text = F.when(F.col("cuts").isNotNull(), _without(F.col("doc")["text"], F.col("cuts"), mark)).otherwise(F.col("doc")["text"])
    cut = cut.select("doc", "cuts", text.alias("text"))
    fields = {c: F.col("doc")[c] for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        fields["n_chars"] = F.when(F.col("cuts").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    return rows.where(F.size("spans") == 0).select("doc.*").unionByName(cut.select(*[v.alias(k) for k, v in fields.items()]))


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """``text`` with the mark for every cut (start, end; ascending, apart).

    What stays between two cuts is taken from parts of PART code points, so each
    is found without a walk from the text's start.
    """

    def between(parts: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / PART).cast("int"), F.floor(end / PART).cast("int")
        inside = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
        return F.substring(inside, begin - first * PART + 1, end - begin)

    def pieces(x: Column) -> Column:
        parts, cut, n = x["parts"], x["cuts"], F.size(x["cuts"])
        at = lambda k, end: F.element_at(cut, k)["end" if end else "start"]
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda i: between(parts, F.when(i == 0, 0).otherwise(at(F.greatest(i, F.lit(1)), True)), F.when(i == n, x["size"]).otherwise(at(F.least(i + 1, n), False))),
        )

    # the one-element array binds the parts, so they are made once a text
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), cuts.alias("cuts"), F.char_length(text).alias("size")))
    return F.array_join(F.element_at(F.transform(bound, pieces), 1), mark)
