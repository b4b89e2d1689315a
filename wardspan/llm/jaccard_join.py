"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. Equal sets are one class. 2. Grouping: sets of at most S tokens together that link differ in at most D tokens, so if
the tokens are dealt by hash into D + 1 parts, one part is the same in both (a few parts more allow to leave out parts that hold
no token; shingles that are common in a sample are left aside). With some more parts than that, linked sets have a known
number of parts in common, and classes that share fewer are left out. Classes that share a part form a bucket; its smallest
member is the leader, and all classes that share some bucket with a leader are the leader's group. Any two classes that link
are together in a group. 3. Each group keeps its token union as the leader's tokens plus every member's difference from them:
rows (group, token, members). A class whose tokens are found in other members too rarely cannot link inside the group (the
overlap bound), so the group is not opened for it. 4. Members that link with the leader are connected through it; no pairs
among them are formed. Groups that are not connected by that are led once more, by their most central member. For the others, opened groups are searched by the rarest difference tokens (prefix filter), only
between classes that are not yet connected, and every candidate is verified on the full sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardspan.llm.common import discard, fresh, stored, text_hash
from wardspan.llm.components import components
from wardspan.llm.shingle_sets import fingerprint, mix, shingles

#: Rows of a lookup table up to which it is broadcast; beyond, it is joined by a shuffle.
_BROADCAST_ROWS = 1_500_000
#: Largest to smallest size of a size class; at least 100 / percent, so that linked sets are at most one class apart.
_RATIO = 1.5
#: Parts beyond those that can differ, as a share of them: linked sets have so many equal parts at least.
_EXTRA = 0.25
_SIG = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Settings:
    """shingle: words per shingle. percent: least Jaccard similarity of a link, in whole percent. sample_docs: documents
    (smallest hashes) in which common shingles are counted; those in ``common`` or more unlike ones do not count for grouping.
    Any choice of these two gives the same links; they only save work."""

    shingle: int = 3
    percent: int = 90
    sample_docs: int = 5_000
    common: int = 3


def most_apart(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Largest symmetric difference of two linked sets with so many tokens together."""
    return total * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Space:
    """Sets of one size class and those of the next smaller one that can link with them. Of ``parts`` parts at least
    ``spare + 1`` are the same in two linked sets, so a set may leave out up to ``spare`` parts: its empty ones."""

    number: int
    high: int
    parts: int
    spare: int

    def need(self, n: int, empty: int, percent: int) -> int:
        """Fewest signatures that a set of n tokens with so many empty parts has in common with a set it links with."""
        return max(1, self.parts - most_apart(n + min(self.high, n * 100 // percent), percent) - empty)


@functools.cache
def _space(number: int, low: int, high: int, percent: int) -> Space:
    differ = most_apart(2 * high, percent)
    spare = 0
    least = max(1, low * percent // 100)  # the smallest sets that come in from the class below
    base = differ + 1 + math.ceil(_EXTRA * differ)
    for _ in range(12):  # their expected number of empty parts and three standard deviations
        empty = (base + spare) * math.exp(-least / (base + spare))
        spare = min(math.ceil(empty + 3 * math.sqrt(empty)), differ + 1)
    return Space(number, high, base + spare, spare)


def spaces(n: int, percent: int) -> list[Space]:
    """The spaces a set of n tokens takes part in: its own size class, and the next if a linked set can be in it."""
    ratio = max(_RATIO, 100 / percent)
    c, low = 0, 1
    while True:
        high = max(low, int(low * ratio))
        if n <= high:
            break
        c, low = c + 1, high + 1
    out = [_space(c, low, high, percent)]
    if n * 100 >= percent * (high + 1):
        out.append(_space(c + 1, high + 1, max(high + 1, int((high + 1) * ratio)), percent))
    return out


def without(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The tokens (sorted) that are not in ``hot`` (sorted)."""
    if not len(hot):
        return tokens
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return tokens[hot[at] != tokens]


def signatures(tokens: np.ndarray, percent: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set's parts in every space, 48 bits and one for odd spaces, and how many of the even and of the
    odd space it must have in common with a set that it links with: equal parts have equal signatures.

    Empty parts would put unlike sets together. They are left out if there are no more of them than can be spared;
    otherwise they count as well. Two linked sets always keep a common signature: if one of them leaves out its empty
    parts, an equal part that is not empty remains, which both have. Tokens in ``hot`` are left aside: without them two
    sets differ in no more tokens than with them.
    """
    out, n, need = [], len(tokens), [0, 0]
    if hot is not None:
        tokens = without(tokens, hot)
    with np.errstate(over="ignore"):
        spread = mix(tokens + np.uint64(0x632BE59BD9B4E019))
        for s in spaces(n, percent):
            part = (((tokens >> np.uint64(32)) * np.uint64(s.parts)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(s.parts, np.uint64)
            # tokens are sorted, and parts are ranges of their upper halves
            first = np.flatnonzero(np.diff(part, prepend=-1))
            if len(first):
                sums[part[first]] = np.add.reduceat(spread, first)
            sigs = mix(sums + mix(np.arange(s.parts, dtype=np.uint64) + np.uint64(s.number << 32)))
            empty = s.parts - len(first)
            listed = sigs if empty > s.spare else sigs[part[first]]
            out.append((listed & _SIG) << np.uint64(1) | np.uint64(s.number & 1))
            need[s.number & 1] = s.need(n, empty, percent)
    return np.concatenate(out).view(np.int64), need


def _over_rows(fn, out_names: list[str], out_types: list[pa.DataType]):
    """An Arrow mapper that makes one output row, or none, of each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 4e6 / (batch.nbytes + 1)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                rows = [r for r in map(fn, *(c.to_pylist() for c in piece.columns)) if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types, strict=True)], out_names)

    return run


def common_shingles(docs: DataFrame, s: Settings) -> np.ndarray:
    """Sorted shingles that occur in several unlike documents of a bounded sample.

    Documents with the same smallest shingle are taken as alike: what near copies share is not common, it is what should
    bring them together.
    """
    some = docs.select(text_hash(F.col("text")).alias("h")).distinct().orderBy(F.xxhash64("h"), "h").limit(s.sample_docs)
    picked = docs.select("text", text_hash(F.col("text")).alias("h")).join(F.broadcast(some), "h", "left_semi").dropDuplicates(["h"]).select("text")

    def one(text):
        t = shingles(text, s.shingle).view(np.int64)
        return (int(t[0]), t.tolist()) if len(t) else None

    rows = picked.mapInArrow(_over_rows(one, ["least", "t"], [pa.int64(), pa.list_(pa.int64())]), "least long, t array<long>")
    seen = rows.select("least", F.explode("t").alias("t")).groupBy("t", "least").count()
    seen = seen.groupBy("t").agg(F.count("*").alias("kinds"), F.sum("count").alias("docs")).where((F.col("kinds") >= s.common) & (2 * F.col("kinds") >= F.col("docs")))
    return np.sort(seen.select("t").toArrow().column("t").to_numpy().astype(np.int64).view(np.uint64))


def set_table(docs: DataFrame, s: Settings) -> DataFrame:
    """Stored rows (doc_id, th, n, cls, sigs, need) of all documents: text hash, set size and fingerprint, signatures of its parts."""
    hot = common_shingles(docs, s)

    def one(doc_id, th, text):
        t = shingles(text, s.shingle)
        sigs, need = signatures(t, s.percent, hot) if len(t) else (t, [0, 0])
        return doc_id, th, len(t), fingerprint(t), sigs.tolist(), need

    names = ["doc_id", "th", "n", "cls", "sigs", "need"]
    run = _over_rows(one, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, th long, n long, cls long, sigs array<long>, need array<int>"), "sets")


def _looked_up(df: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a stored table that is broadcast only if it has been counted to be small."""
    return df.join(F.broadcast(table) if table.count() <= _BROADCAST_ROWS else table, on, how)


def membership(sets: DataFrame) -> DataFrame:
    """Stored (cls, leader): distinct memberships in groups of two classes or more; leaders are members of their groups.

    A signature that only one class has is no link. A class that shares fewer of its signatures, with whatever classes, than
    two linked sets have in common cannot link with any: it is left out before groups are made. The first class of a signature
    leads. Rows without id are linked with nothing, so they take no part: as leaders they would have no stored set.
    """
    parts = sets.where("n > 0 and doc_id is not null").select("cls", "need", F.explode("sigs").alias("sig"))
    side = F.col("sig").bitwiseAND(F.lit(1))
    w = W.partitionBy("sig")
    shared = parts.select("cls", F.get("need", side.cast("int")).alias("need"), "sig", F.min("cls").over(w).alias("lo"), F.max("cls").over(w).alias("hi"))
    shared = stored(shared.where("lo <> hi").select("cls", side.alias("side"), "need", "sig"), "shared")
    strong = shared.groupBy("cls", "side", "need").agg(F.count("*").alias("n")).where("n >= need").select("cls", "side")
    first = shared.join(strong, ["cls", "side"], "left_semi").select("cls", F.min("cls").over(w).alias("leader"))
    led = stored(first.where("cls <> leader").distinct(), "led")
    discard(shared)
    return stored(led.union(led.select("leader", "leader").distinct()), "groups")


def class_tokens(docs: DataFrame, sets: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """Stored (cls, n, tokens): the sets of the wanted classes, each from its smallest document."""
    # one row per class: its smallest document; a row that occurs several times is read once
    rows = sets.where("n > 0 and doc_id is not null").join(wanted, "cls", "left_semi")
    row = F.struct("doc_id", "th")
    best = rows.groupBy("cls", row.alias("row")).agg(F.count("*").alias("times")).groupBy("cls").agg(F.min(F.struct("row", "times")).alias("b"))
    ids = stored(best.select("cls", F.col("b.row.doc_id").alias("doc_id"), F.col("b.row.th").alias("th"), F.col("b.times").alias("times")), "class-documents")

    def one(cls, text):
        t = shingles(text, s.shingle)
        return cls, len(t), t.tobytes()

    run = _over_rows(one, ["cls", "n", "tokens"], [pa.int64(), pa.int64(), pa.binary()])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), "text")
    found = _looked_up(texts, ids, ["doc_id", "th"]).select("cls", "times", "text")
    once, again = found.where("times = 1").select("cls", "text"), found.where("times > 1").dropDuplicates(["cls"]).select("cls", "text")
    return stored(once.unionByName(again).mapInArrow(run, "cls long, n long, tokens binary"), "class-tokens")


def _tokens(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def differences(groups: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Stored (cls, leader, n, apart, linked, delta): difference from the leader's set, for all members but the leader."""

    def one(cls, leader, n, tokens, n_leader, theirs):
        d = np.setxor1d(_tokens(tokens), _tokens(theirs), assume_unique=True)
        return cls, leader, n, len(d), bool(len(d) <= most_apart(n + n_leader, s.percent)), d.view(np.int64).tolist()

    run = _over_rows(one, ["cls", "leader", "n", "apart", "linked", "delta"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())])
    own = sets.select("cls", "n", "tokens")
    led = sets.select(F.col("cls").alias("leader"), F.col("n").alias("n_leader"), F.col("tokens").alias("theirs"))
    rows = groups.where("cls <> leader").join(own, "cls").join(led, "leader").select("cls", "leader", "n", "tokens", "n_leader", "theirs")
    return stored(rows.mapInArrow(run, "cls long, leader long, n long, apart long, linked boolean, delta array<long>"), "differences")


def _torn(diffs: DataFrame, comps: DataFrame) -> DataFrame:
    """Stored differences with their components, of groups whose members, the leader aside, are not all connected: the
    other groups have nothing left to find."""
    d = diffs.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce(F.col("component"), F.col("cls")))
    torn = d.groupBy("leader").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("n").alias("n_max"), F.min("n").alias("n_min"), F.count("*").alias("size"))
    return stored(d.join(torn.where("c1 <> c2").drop("c1", "c2"), "leader"), "torn-groups")


def _cells(d: DataFrame, *columns: str) -> DataFrame:
    """The matrix: how many members of the group differ from the leader in this token, where more than one does."""
    cells = d.select("cls", "leader", *columns, F.explode("delta").alias("token"))
    return cells.join(cells.groupBy("leader", "token").agg(F.count("*").alias("members")).where("members > 1"), ["leader", "token"])


def recentred(diffs: DataFrame, comps: DataFrame) -> DataFrame:
    """Stored (cls, leader): the members of torn groups, each group led by its member with the least sum of distances to all others.

    From there members differ in little but their own changes, so more of them link with the leader and few of the others
    share a token. Groups with the same centre become one; whoever was together in a group still is.
    """
    d = _torn(diffs, comps)
    common = _cells(d).groupBy("leader", "cls").agg(F.sum(F.col("members") - 1).alias("common"))
    # over all members u, the leader with its empty difference included: the sum of |delta u ^ delta v|, less that of |delta u|
    far = F.col("apart") * (F.col("size") + 1) - 2 * (F.col("apart") + F.coalesce(F.col("common"), F.lit(0)))
    best = d.join(common, ["leader", "cls"], "left").groupBy("leader").agg(F.min(F.struct(far.alias("far"), F.col("cls").alias("centre"))).alias("v"))
    best = stored(best.select("leader", F.when(F.col("v.far") < 0, F.col("v.centre")).otherwise(F.col("leader")).alias("centre")), "centres")
    members = d.select("cls", "leader").union(best.select(F.col("leader").alias("cls"), "leader"))
    return stored(_looked_up(members, best, "leader").select("cls", F.col("centre").alias("leader")).distinct(), "centred-groups")


def opened_pairs(diffs: DataFrame, comps: DataFrame, s: Settings) -> DataFrame:
    """(a, b): candidates from the groups that a class must open; never two classes that are connected already."""
    cells = _cells(_torn(diffs, comps), "n", "apart", "linked", "component", "n_max", "n_min")
    # differences that no other member has never come back in an overlap: both differ there for sure
    per = W.partitionBy("cls", "leader")
    cells = cells.withColumns({"shared": F.count("*").over(per), "rank": F.row_number().over(per.orderBy("members", "token"))})
    far = lambda total: F.floor(total * (100 - s.percent) / (100 + s.percent))
    # d(x, v) >= |delta x| - |shared delta x|: the bound that keeps a group closed
    limit = far(F.col("n") + F.least(F.col("n_max"), F.floor(F.col("n") * 100 / s.percent)))
    cells = stored(cells.where(F.col("apart") - F.col("shared") <= limit).withColumn("limit", limit), "matrix")
    # x is not linked with the leader, and v has at most |delta v| tokens more than the leader; so if x and v link, they
    # share at least the part (1 - f) / 2 of delta v, where f = (100 - percent) / (100 + percent)
    need = F.floor(F.col("apart") * s.percent / (100 + s.percent)).cast("long")
    unique = F.col("apart") - F.col("shared")
    indexed = cells.where(F.col("rank") <= F.col("apart") - F.greatest(need, F.lit(1)) + 1 - unique)
    probing = cells.where(~F.col("linked")).where(F.col("rank") <= F.col("limit") + 1 - unique)
    side = lambda df, x: df.select(
        "leader", "token", F.col("cls").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("apart").alias(f"d{x}"), (F.col("shared") - F.col("rank")).alias(f"r{x}"))
    left, right = side(probing, "a"), side(indexed, "b")
    size = (100 * F.col("na") >= s.percent * F.col("nb")) & (100 * F.col("nb") >= s.percent * F.col("na"))
    # position: with this as their first common difference, enough of them must be left in both to come within the limit
    reach = F.col("da") + F.col("db") - 2 * (1 + F.least("ra", "rb")) <= far(F.col("na") + F.col("nb"))
    pairs = left.join(right, (left["leader"] == right["leader"]) & (left["token"] == right["token"]) & (left["ca"] != right["cb"]) & size & reach)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def one(a, b, mine, theirs):
        x, y = _tokens(mine), _tokens(theirs)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if 100 * both >= s.percent * (len(x) + len(y) - both) else None

    mine = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("mine"))
    theirs = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("theirs"))
    rows = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "mine", "theirs")
    return rows.mapInArrow(_over_rows(one, ["a", "b"], [pa.int64(), pa.int64()]), "a long, b long")


def components_of(docs: DataFrame, s: Settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_shingles, component_id."""
    signed = set_table(docs, s)
    groups = membership(signed)
    # the signatures, far longer than all other columns, are not needed any more
    sets = stored(signed.drop("sigs", "need"), "classes")
    discard(signed)
    tokens = class_tokens(docs, sets, groups.select("cls").distinct(), s)
    diffs = differences(groups, tokens, s)
    links = diffs.where("linked").select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    first = stored(components(links), "connected")
    diffs = differences(recentred(diffs, first), tokens, s)
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(diffs.where("linked").select("cls", "leader"))
    first = stored(components(links), "connected")
    more = stored(verified(opened_pairs(diffs, first, s), tokens, s), "links")
    comps = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "all-links")
    # classes to documents; equal ids tie their classes together
    known = sets.where("n > 0 and doc_id is not null")
    reps = known.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    at = reps.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = at.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = stored(at.join(least, "component").select(F.col("cls").alias("k"), "component_id"), "class-components")
    twice = known.groupBy("doc_id").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2")).where("c1 <> c2").select("doc_id")
    ids = _tied(ids, known.join(twice, "doc_id", "left_semi"))
    out = sets.join(ids, sets["cls"] == ids["k"], "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), own.alias("component_id"))


def grouped(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    NULL and empty texts have no shingles and are linked with nothing: their component is their own id. Rows with equal ids
    are one node. Rows without id are counted but linked with nothing, their component is NULL. Ties are no matter: a
    component's id is its smallest doc_id. An empty table gives an empty result; extra columns do not matter.
    """
    return components_of(docs, s).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` of each component's smallest doc_id, with their own columns.

    If that id occurs in several rows the one with the smallest text hash stays, once. Rows without words or without id are
    linked with nothing and stay.
    """
    rows = components_of(docs, s)
    h, free, of, least, times = (fresh(docs.columns, x) for x in ("text_hash", "free", "kept_id", "least_hash", "times"))
    best = rows.where("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias(of)).agg(F.min("th").alias(least), F.count("*").alias(times))
    best = stored(best, "kept")
    # the words of a text are what is left without ASCII white space
    marked = docs.withColumn(h, text_hash(F.col("text"))).withColumn(free, F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    chosen = marked.where(~F.col(free)).join(best, (F.col("doc_id") == F.col(of)) & (F.col(h) == F.col(least)))
    once = chosen.where(F.col(times) == 1).select(*docs.columns)
    repeated = chosen.where(F.col(times) > 1).dropDuplicates(["doc_id", h]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(marked.where(free).select(*docs.columns))


def _tied(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Components that hold texts of the same document id, merged."""
    rows = stored(rows.select("doc_id", F.col("cls").alias("k")).distinct(), "repeated-ids")
    if rows.isEmpty():
        return ids
    meet = rows.join(ids, "k").select("doc_id", "component_id").distinct()
    meet = meet.join(meet.groupBy("doc_id").agg(F.min("component_id").alias("b")), "doc_id")
    merged = stored(components(meet.select(F.col("component_id").alias("a"), "b"), "ties"), "tied")
    to = merged.select(F.col("node").alias("component_id"), F.col("component").alias("to"))
    return ids.join(to, "component_id", "left").select("k", F.coalesce("to", "component_id").alias("component_id"))
