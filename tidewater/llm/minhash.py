"""Near-duplicates by min-max hashing.

Each of ``BANDS * ROWS / 2`` permutations of a document's shingle hashes gives two signature
values, its minimum and its maximum: half the hash evaluations for the same signature.  Bands
of ROWS values find candidates; a link is made when the full shingle sets pass
100 * |intersection| >= percent * |union|.  A pair at exactly 0.8 shares no band with
probability (1 - 0.8^6)^44 < 2e-6.

Copies and large groups
  * documents with equal sets form one class under their smallest id (128-bit digest of the set);
    only that representative goes on;
  * in a band bucket pairs are never all listed.  First every document is compared with the foremost
    hub of its buckets.  Buckets that aren't one component then are worked on by hub: the documents of
    a hub's open buckets are compared with the hub, which leaves of each only what it lacks and has
    beyond the hub.  Two documents that aren't both linked to the hub can only be linked if more than
    about half of the difference of one is also in the other's, so differences that one document has
    alone rule most pairs out.  The rest meets ``CENTRES`` centres a hub first (where a group hangs
    together it mostly becomes one component here), then, in hubs of more documents, everyone who
    shares one of the rarest parts of a difference (a prefix filter).  Both are exact: whatever shares
    a bucket and is alike enough, is linked.

Defined results: no words or null text give an empty set, linked with nothing; rows of one id are
one document, whose set is that of the text with fewest shingles (ties: least hashes); null ids stay unlinked (component
null, kept); an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import col, columns, connected_components, forget, mix64, per_text, scratch, shingle_hashes, table

BANDS, ROWS = 44, 6
#: Centres of a hub in the round after the stars (all of its documents where there are no more).
CENTRES = 128

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**32, BANDS * ROWS // 2, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS // 2, dtype=np.uint32)


def min_max_signature(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set of hashes under each permutation."""
    low = np.full(len(_MUL), 2**32 - 1, np.uint32)
    high = np.zeros(len(_MUL), np.uint32)
    top = (h >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(top), 512):
            x = top[at : at + 512, None] * _MUL + _ADD
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            np.minimum(low, x.min(axis=0), out=low)
            np.maximum(high, x.max(axis=0), out=high)
    return low, high


def bands(h: np.ndarray) -> np.ndarray:
    low, high = min_max_signature(h)
    v = np.stack([low, high], axis=1).reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            out = mix64(out + v[:, j] * np.uint64(0xD1342543DE82EF95))
    return out.view(np.int64)


def _sketch(k: int):
    def one(text):
        h = shingle_hashes(text, k)
        if not len(h):
            return 0, None, None, None
        with np.errstate(over="ignore"):
            d1 = int(mix64(h).sum(dtype=np.uint64).view(np.int64))
            d2 = int(mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))
        return len(h), d1, d2, bands(h)

    return one


def _set_of(k: int):
    def one(text):
        h = shingle_hashes(text, k)
        return len(h), h.view(np.int64)

    return one


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of ``docs``."""
    with scratch() as keep:
        return keep(table(_near_duplicates(docs, k, percent, id_col, text_col), "near"))


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    ids = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    long_list = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", long_list)])
    sketches = table(ids.mapInArrow(per_text(_sketch(k), schema, ["id"]), "id long, n long, d1 long, d2 long, bands array<long>"), "sketch")

    keyed = sketches.where("d1 is not null and id is not null")
    classes = table(keyed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    member = table(
        sketches.join(classes, ["d1", "d2"], "left").select(
            "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), F.when(F.coalesce("rep", "id") == F.col("id"), F.col("bands")).alias("bands")
        ),
        "member",
    )
    forget(sketches, classes)
    rows = member.where("bands is not null").select("id", F.explode("bands").alias("b"))
    buckets = table(rows.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    live = table(rows.join(buckets, "b"), "live")
    forget(buckets)
    texts = ids.join(live.select("id").distinct(), "id", "left_semi")
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", long_list)])
    sets = texts.mapInArrow(per_text(_set_of(k), schema, ["id"]), "id long, n long, s array<long>")
    sets = table(sets.groupBy("id").agg(F.min(F.struct("n", "s")).alias("x")).select("id", "x.n", "x.s"), "sets")

    # Stars: a bucket's hub is its document that meets most others over all buckets, in a group of edited
    # copies the least edited one; every document is compared with the foremost of its hubs.
    score = live.groupBy("id").agg(F.sum("m").alias("score"))
    hubs = table(live.join(score, "id").groupBy("b").agg(F.max(F.struct("score", "id")).alias("hub")), "hubs")
    best = live.join(hubs, "b").groupBy("id").agg(F.max("hub").alias("hub"))
    stars = table(best.select(F.col("id").alias("a"), F.col("hub.id").alias("b")).where("a <> b"), "stars")
    links = table(_verify(stars, sets, percent), "links")
    comp = connected_components(links)
    here = table(_open(live, comp), "here")
    forget(stars)
    if here.head(1):
        by_hub = here.join(hubs, "b").select(F.col("hub.id").alias("hub"), "id", "g").distinct()
        gaps = table(_gaps(by_hub, sets), "gaps")
        rows, tokens = _possible(gaps, percent)
        more = table(_near_hub(gaps, percent).unionByName(_verify(_centre_pairs(rows, percent), sets, percent)), "links")
        forget(gaps)
        links, comp = _with_links(links, more, comp)
        rest = table(_still_open(rows, comp), "rest")
        if rest.head(1):
            more = table(_verify(table(_prefix_pairs(rest, tokens, percent), "pairs"), sets, percent), "links")
            links, comp = _with_links(links, more, comp)
    out = member.join(comp, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _open(live: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component g."""
    named = live.join(comp.withColumnRenamed("node", "id"), "id", "left").select("b", "id", F.coalesce("component", "id").alias("g"))
    several = named.groupBy("b").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1")
    return named.join(table(several.select("b"), "open"), "b")


def _with_links(links: DataFrame, more: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not more.head(1):
        return links, comp
    links = table(links.unionByName(more), "links")
    return links, connected_components(links)


def _gaps(by_hub: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, id, g, n, nh, lacks, has): the sizes of a document's and its hub's sets, and their differences."""
    one = table(by_hub, "by-hub").join(sets.select("id", "n", "s"), "id")
    two = one.join(sets.select(F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("s").alias("h")), "hub")
    return two.select("hub", "id", "g", "n", "nh", F.array_except("h", "s").alias("lacks"), F.array_except("s", "h").alias("has"))


def _near_hub(gaps: DataFrame, percent: int) -> DataFrame:
    both = F.col("n") - F.size("has")
    near = gaps.where((F.col("id") != F.col("hub")) & (100 * both >= percent * (F.col("nh") + F.size("has"))))
    return near.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"))


def _possible(gaps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (hub, id, g, n, nh, lacks, has, sl, sh, far, fits, size) that may have a link which the hub
    doesn't show, and the parts of differences (hub, id, t, c) that c > 1 documents of the hub share.

    lacks and has are numbers here, sl and sh those of shared parts; far: not linked to the hub.
    A pair (s, t) is linked if its shared parts are at least
    need = p (n_s + n_t) / (100 + p) - n_hub + lacks_s + lacks_t, and if s is far, that is more than
    p (has_t - lacks_t) / (100 + p) + lacks_t, which t alone decides: ``fits`` says whether t has as many."""
    size = table(gaps.groupBy("hub").agg(F.count("*").alias("size")), "sizes")
    part = lambda c, flag: F.transform(c, lambda t: F.struct(t.alias("t"), F.lit(flag).alias("l")))
    long = gaps.select("hub", "id", F.inline(F.concat(part("lacks", True), part("has", False))))
    long = table(long, "parts")
    shared = long.groupBy("hub", "t").agg(F.count("*").alias("c")).where("c > 1")
    tokens = table(long.join(table(shared, "shared"), ["hub", "t"]), "tokens")
    own = tokens.groupBy("hub", "id").agg(F.count_if("l").alias("sl"), F.count_if(~F.col("l")).alias("sh"))
    rows = gaps.select("hub", "id", "g", "n", "nh", F.size("lacks").alias("lacks"), F.size("has").alias("has"))
    rows = rows.join(own, ["hub", "id"], "left").join(size, "hub")
    rows = rows.withColumns({
        "sl": F.coalesce("sl", F.lit(0)),
        "sh": F.coalesce("sh", F.lit(0)),
        "far": 100 * (F.col("n") - F.col("has")) < percent * (F.col("nh") + F.col("has")),
    })
    least = percent * (F.col("has") - F.col("lacks")) + (100 + percent) * F.col("lacks")
    rows = rows.withColumn("fits", (100 + percent) * (F.col("sl") + F.col("sh")) > least)
    return table(rows.where("far or fits"), "rows"), tokens


def _may_link(percent: int):
    """Whether the shared parts of a row and of one with ``c`` before its names can suffice."""
    need = percent * (F.col("n") + F.col("cn")) + (100 + percent) * (F.col("lacks") + F.col("clacks") - F.col("nh"))
    most = F.least("sl", "csl") + F.least("sh", "csh")
    return (F.col("g") != F.col("cg")) & (F.col("far") | F.col("cfar")) & ((100 + percent) * most >= need)


def _other(rows: DataFrame) -> DataFrame:
    return rows.select("hub", *[F.col(c).alias(f"c{c}") for c in ("id", "g", "n", "lacks", "sl", "sh", "far")])


def _centre_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each row with the centres of its hub: by a hash, CENTRES of those that may have a link."""
    size = table(rows.groupBy("hub").agg(F.count("*").alias("m")), "sizes")
    at = F.pmod(F.xxhash64("hub", "id"), F.lit(1 << 30)) / float(1 << 30) * F.col("m")
    centres = rows.join(size, "hub").where((at < CENTRES) | (F.col("m") <= CENTRES))
    pairs = rows.join(table(_other(centres), "centres"), "hub").where(_may_link(percent) & (F.col("id") != F.col("cid")))
    return table(pairs.select(F.greatest("id", "cid").alias("a"), F.least("id", "cid").alias("b")).distinct(), "pairs")


def _still_open(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of large hubs that hold several components, with the new component g."""
    named = rows.where(F.col("size") > CENTRES).drop("g").join(comp.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("g", F.coalesce("component", "id")).drop("component")
    several = named.groupBy("hub").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.max("far").alias("far")).where("g0 < g1 and far")
    return named.join(table(several.select("hub"), "open"), "hub")


def _prefix_pairs(rest: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of a far row and one that fits, which share one of the latter's rarest parts: it needs k of
    its sl + sh shared parts, so one of any sl + sh - k + 1 of them is common."""
    k = F.floor((percent * (F.col("has") - F.col("lacks")) + (100 + percent) * F.col("lacks")) / (100 + percent)) + 1
    first = rest.where("fits").withColumn("first", F.col("sl") + F.col("sh") - k + 1).where("first > 0")
    own = Window.partitionBy("hub", "id").orderBy("c", "t")
    ranked = tokens.withColumn("r", F.row_number().over(own)).join(first, ["hub", "id"]).where("r <= first")
    left = table(ranked.select("hub", "t", "id", "g", "n", "nh", "lacks", "sl", "sh", "far"), "prefix")
    right = table(tokens.select("hub", "id", "t").join(rest.where("far"), ["hub", "id"]).select("t", "hub", "id", "g", "n", "lacks", "sl", "sh", "far"), "far")
    right = right.select("t", "hub", *[F.col(c).alias(f"c{c}") for c in ("id", "g", "n", "lacks", "sl", "sh", "far")])
    pairs = left.join(right, ["hub", "t"]).where(_may_link(percent) & (F.col("id") != F.col("cid")))
    return pairs.select(F.greatest("id", "cid").alias("a"), F.least("id", "cid").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    # Sizes further apart than the limit allows can't pass; the intersection isn't worked out.
    na, nb = F.size("sa"), F.size("sb")
    near = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(near).where(100 * both >= percent * (na + nb - both)).select("a", "b")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near-duplicates; repeated rows of
    one id count once, as that with the text first in order (ties by a hash of the row); null ids stay."""
    found = near_duplicates(docs, k, percent, id_col, text_col)
    kept = found.where("kept").select(col(id_col).alias("__nd_id")).where("__nd_id is not null").distinct()
    known = docs.where(col(id_col).isNotNull()).join(kept, col(id_col) == F.col("__nd_id"), "left_semi")
    # Maps can't be hashed, so they don't break ties.
    tie = F.xxhash64(*[col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    known = known.groupBy(col(id_col).alias("__nd_id")).agg(F.min_by(F.struct(*columns(docs)), F.struct(col(text_col), tie)).alias("__nd_row"))
    return known.select("__nd_row.*").unionByName(docs.where(col(id_col).isNull()))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.i >= 80 * (na.n + nb.n - x.i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""
