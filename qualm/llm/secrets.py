"""Operator 6: secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Base patterns mark candidates in every whole text. A wider pattern adds long mixed tokens (kind ``blob``) outside the
base spans. All candidate values are hashed and counted by distinct repositories and owners over the corpus: a value of
EXAMPLE_OWNERS owners or more, or of EXAMPLE_REPOS repositories or more (a template that one owner copies about), is a widely
copied example; any other that looks random is live. Base spans are always reported; a blob is reported if it is live.

Owner and repository are columns the caller names; the query takes ``source`` and ``doc_id``. Only texts with a match
are cut up, and only spans and hashes are shuffled. Values that a third of all rows hold are counted from distinct
(value, owner, repository) rows and joined back over salted copies of the few counts.

Defined results: null texts are empty; no match gives zeros, the digest of the empty string and an empty list; a null owner
or repository is one of its own; rows that repeat a document get the same result each; ties in start are ordered by kind.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, text_of

#: The kinds in order, each with its pattern, the group that holds the value, and its least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
    ("blob", r"([A-Za-z0-9_-]{24,})", 1, 24),
]
#: What a text must match before it is cut up by a kind's pattern.
HINTS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "blob": r"[A-Za-z0-9_-]{24}"}
BASE, EXAMPLE_OWNERS, EXAMPLE_REPOS, SALTS, LEAST_DISTINCT = 3, 3, 100, 16, 8


def found_in(text: Column) -> Column:
    """An array of (kind, n, gap, size, value): every match of a kind's pattern with the length of the text before it."""
    def of(k: int) -> Column:
        name, pattern, group, _ = KINDS[k]
        whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
        pieces = F.split(text, pattern, -1)
        zipped = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
        rows = F.transform(zipped, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("n"), F.length(x["p"]).alias("gap"),
                                                         F.length(x["m"]).alias("size"), x["v"].alias("value")))
        return F.when(text.rlike(HINTS[name]), rows).otherwise(F.array().cast("array<struct<kind:int,n:int,gap:int,size:int,value:string>>"))

    return F.concat(*[of(k) for k in range(len(KINDS))])


def looks_random(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """(doc, version, owner, repo, kind, start, end, hash, random) of every span, blobs over base spans left out."""
    text = text_of("text")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("version"), named(owner).alias("owner"), named(repo).alias("repo"),
                       text.alias("text")).where(text.rlike("|".join(f"(?:{h})" for h in HINTS.values())))
    spans = (rows.select("doc", "version", "owner", "repo", F.inline(found_in(F.col("text"))))
             .dropDuplicates(["doc", "version", "owner", "repo", "kind", "n"]))
    along = Window.partitionBy("doc", "version", "owner", "repo", "kind").orderBy("n")
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    spans = spans.where((F.length("value") >= least) & ((F.col("kind") < BASE) | looks_random(F.col("value"))))
    ahead = Window.partitionBy("doc", "version", "owner", "repo").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("doc", "version", "owner", "repo").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("kind") < BASE
    spans = (spans.withColumn("ended", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(base, F.col("start"))).over(back)))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return spans.where(base | free).select("doc", "version", "owner", "repo", "kind", "start", "end", F.xxhash64("value").alias("hash"),
                                           looks_random(F.col("value")).alias("random"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, repos, owners: distinct repositories and owners of each candidate value."""
    return (spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
            .groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners")))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", example_owners: int = EXAMPLE_OWNERS,
         example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, then n_live, n_example, and most owners (widest) and most
    repositories (most_repos) of a value in the document."""
    spans = cut(candidates(docs, owner, repo))
    salted = ownership(spans).select(F.col("hash").alias("h"), "owners", "repos", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS)).cast("int")
    judged = (spans.join(salted, (F.col("hash") == F.col("h")) & (salt == F.col("salt")))
              .withColumn("example", (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)).withColumn("live", ~F.col("example") & F.col("random"))
              .where((F.col("kind") < BASE) | F.col("live")))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    per_doc = judged.groupBy("doc", "version", "owner", "repo").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sort_array(F.collect_list(span)).alias("all"), F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("example"), 1)).alias("n_example"), F.max("owners").alias("widest"), F.max("repos").alias("most_repos"))
    join_names = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    per_doc = (per_doc.withColumn("base", join_names(F.filter("all", lambda x: x["kind"] < BASE))).withColumn("spans", join_names(F.col("all")))
               .withColumnRenamed("doc", "d").withColumnRenamed("version", "v").withColumnRenamed("owner", "o").withColumnRenamed("repo", "r"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text_of("text")).alias("version"), named(owner).alias("owner"), named(repo).alias("repo"))
    joined = rows.join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("owner") == F.col("o"))
                       & (F.col("repo") == F.col("r")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(F.col("doc").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"),
                         F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
                         zero("n_live"), zero("n_example"), zero("widest"), zero("most_repos"))
