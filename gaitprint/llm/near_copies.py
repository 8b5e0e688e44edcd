"""Near copies by b-bit MinHash (operator 4).

A document's set is its distinct runs of five words.  Of each of 128 minima four low bits are kept, packed
into eight 64-bit words; 32 bands of four whole minima find candidates.  A candidate's similarity is
estimated from the packed words by bit counts, corrected for chance agreement, and what may reach the
threshold is confirmed on the full sets, rebuilt from the texts.

Equal sets are one node from the start.  In each band bucket every node is first compared with the
bucket's smallest one only; nodes that this links are one component.  What is left are buckets that still
hold several components: small ones give the pairs between components; large ones are cut into blocks of
bounded size whose packed words meet two by two in tasks, and a bucket's largest component doesn't meet
itself.  Nodes that may have a partner there meet again with their texts, and give only links that join
components.  So no group of copies becomes all its pairs, and no link between components is lost.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32, about 5e-8 (6e-11 at 0.85), and a
true pair falls below the estimate's bound (six standard errors) less often still.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitprint.llm.common import drop_tables, free_name, mix64, own_columns, slices, stage_table

WORDS = 5
#: Hundredths of the union that the intersection of linked sets reaches.
THRESHOLD = 80
HASHES, BANDS, BITS = 128, 32, 4
#: Estimates so many standard errors below the threshold are still confirmed.
ERRORS = 6
#: Buckets of up to so many nodes give pairs; larger ones are cut into blocks of about BLOCK nodes.
SMALL, BLOCK = 32, 512
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    bytes_ = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    factors = rng.integers(1, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return bytes_, places, factors


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its distinct shingles (empty without words)."""
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = _LOWER[np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)]
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    of_byte, of_place, _ = _constants()
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(of_byte[data] * power, out=sums[1:])
    w = mix64((sums[ends] - sums[starts]) * inverse[starts])
    rows = np.cumsum([1, *(len(t) + 1 for t in raw)])
    first = np.searchsorted(starts, rows)
    n = np.diff(first)
    run = np.zeros(max(0, len(w) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        run += w[k : k + len(run)] * of_place[k]
    run = mix64(run)
    sets = []
    for i, (a, c) in enumerate(zip(first[:-1].tolist(), n.tolist(), strict=True)):
        if c >= WORDS:
            sets.append(np.unique(run[a : a + c - WORDS + 1]))
        elif c:
            sets.append(mix64((w[a : a + c] * of_place[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(values: np.ndarray) -> np.ndarray:
    """The 128 minima of a set."""
    factors = _constants()[2]
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * factors[None, :]).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Rows of minima as rows of eight 64-bit words: four low bits of each (mixed) minimum."""
    bits = (mix64(low.astype(np.uint64)) & np.uint64(15)).reshape(len(low), HASHES // 16, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).astype(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """Rows of minima as rows of one 64-bit key per band."""
    rows = low.reshape(len(low), BANDS, -1).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix64(key ^ (rows[:, :, k] + np.uint64(k << 40)) * _BASE)
    return key.astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sets (sorted, without repeats) reach the threshold."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


_SIGNED = "doc_id long, n_shingles long, same binary, bands array<long>, " + ", ".join(f"s{k} long" for k in range(HASHES // 16))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): size and 128-bit fingerprint of its set, band keys and packed minima.

    Null texts have the empty set; nulls in doc_id stay.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            sets = shingle_sets(batch.column(1))
            low = np.stack([minima(s) for s in sets])
            same = [np.array([mix64(s).sum(dtype=np.uint64), (mix64(s ^ _BASE)).sum(dtype=np.uint64)]).tobytes() for s in sets]
            bands, words = band_keys(low), packed(low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(same, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                    *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1])),
                ],
                names=[x.split()[0] for x in _SIGNED.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, _SIGNED)


def estimate(a: str, b: str) -> Column:
    """Similarity of two rows' sets from their packed words (columns a.s0.. and b.s0..), corrected for chance agreement."""
    ones = F.lit(0x1111111111111111).cast("long")

    def differing(k: int) -> Column:
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(ones))

    agree = 1 - reduce(Column.__add__, map(differing, range(HASHES // 16))) / HASHES
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_estimate(threshold: int) -> float:
    """The estimate from which a pair is confirmed on its full sets."""
    agree = threshold / 100 * (1 - 2.0**-BITS) + 2.0**-BITS
    return threshold / 100 - ERRORS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _words() -> list[str]:
    return [f"s{k}" for k in range(HASHES // 16)]


def _screened(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimates may reach it."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.struct("n_shingles", *_words()).alias(f"{x}_"))
    sized = 100 * F.least("a_.n_shingles", "b_.n_shingles") >= threshold * F.greatest("a_.n_shingles", "b_.n_shingles")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized & (estimate("a_", "b_") >= least_estimate(threshold))).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets reach the threshold; ``texts``: node, text."""
    pairs = stage_table(pairs, "pairs")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in slices(batches, "text_a", 1 << 20):
            for batch in slices([both], "text_b", 1 << 20):
                left, right = shingle_sets(batch.column(2)), shingle_sets(batch.column(3))
                good = pa.array([linked(x, y, threshold) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    found = stage_table(both.mapInArrow(confirm, "a long, b long").distinct(), "links")
    drop_tables(pairs)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest id reachable) of every id in ``links`` (a, b), by smallest labels and pointer jumping.

    Each round's labels are a table of their own, so a lost executor costs a reread.
    """
    both = stage_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "both-ways")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_b")), "b").groupBy("a").agg(F.min("of_b").alias("of_b"))
        lower = stage_table(
            labels.join(near.select(F.col("a").alias("node"), "of_b"), "node").select("node", F.col("label").alias("old"), F.least("label", "of_b").alias("new")), "lower"
        )
        jumped = lower.join(lower.select(F.col("node").alias("new"), F.col("new").alias("label")), "new").select("node", "old", "label")
        jumped = stage_table(jumped, "labels")
        drop_tables(labels, lower)
        labels = jumped
        if not jumped.where(F.col("old") != F.col("label")).limit(1).count():
            drop_tables(both)
            return labels.select("node", F.col("label").alias("component"))


def _between_components(nodes: DataFrame, texts: DataFrame, joined: DataFrame, buckets: DataFrame, threshold: int) -> DataFrame:
    """Links between components that share a bucket, as a table."""
    inside = (
        nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
        .join(buckets.select("key", "n"), "key")
        .join(joined, "node", "left")
        .select("key", "n", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    )
    inside = stage_table(inside, "in-buckets")
    # Of each bucket: whether it holds several components, and which of them has the most nodes.
    per = inside.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    open_ = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("c", "component")).alias("bulk"), F.max("c").alias("bulk_n")).where("parts > 1").drop("parts")
    members = stage_table(inside.join(open_, "key"), "members")
    few = members.where(F.col("n") <= SMALL)
    other = few.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component").alias("c_b"))
    pairs = (
        few.join(other, "key")
        .where((F.col("node") < F.col("b")) & (F.col("component") != F.col("c_b")))
        .where(100 * F.least("n_shingles", "n_b") >= threshold * F.greatest("n_shingles", "n_b"))
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )
    found = _confirmed(_screened(pairs, nodes, threshold), texts, threshold)

    placed = _placed(members.where(F.col("n") > SMALL), nodes)
    group = ["key", "i", "j"]
    # First by packed words alone, then the texts of those that may have a partner.
    some = placed.groupBy(*group).applyInPandas(lambda g: _with_partners(g, threshold), "key long, i int, j int, own int, node long, component long")
    some = stage_table(some, "partners")
    whole = some.join(nodes.select("node", "n_shingles", "bands", *_words()), "node").join(texts, "node")
    links = stage_table(whole.groupBy(*group).applyInPandas(lambda g: _links_within(g, threshold), "a long, b long"), "links")
    drop_tables(inside, members, some)
    return found.union(links)


def _placed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of large buckets (key, n, node, n_shingles, component, and the largest one as bulk, bulk_n) with the pairs of blocks i, j they meet in.

    Buckets are cut into blocks of about BLOCK nodes: first those outside of the largest component, then that
    component's.  Blocks meet two by two, but not two of the largest component; if it holds nearly all of a
    bucket, each of its nodes is met once.
    """
    minor = F.col("component") != F.col("bulk")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    many = members.withColumn("outside", blocks(F.col("n") - F.col("bulk_n"))).withColumn("all", F.col("outside") + blocks(F.col("bulk_n")))
    hashed = F.xxhash64("node")
    own = F.when(minor, F.pmod(hashed, "outside")).otherwise(F.col("outside") + F.pmod(hashed, F.col("all") - F.col("outside"))).cast("int")
    return (
        many.join(nodes.select("node", *_words()), "node")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("all")).otherwise(F.col("outside")) - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n_shingles", "component", *_words())
    )


def _close(group: pd.DataFrame, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a group of two blocks (or of one), the rows after it in the other that may reach the threshold and aren't in its component."""
    w = np.ascontiguousarray(group[_words()].to_numpy(dtype=np.int64)).view(np.uint64)
    n, own, component = (group[c].to_numpy() for c in ("n_shingles", "own", "component"))
    across = group["i"].iloc[0] != group["j"].iloc[0]
    for i in range(len(group) - 1):
        may = component[i + 1 :] != component[i]
        may &= 100 * np.minimum(n[i], n[i + 1 :]) >= threshold * np.maximum(n[i], n[i + 1 :])
        if across:
            may &= own[i + 1 :] != own[i]
        at = np.flatnonzero(may) + i + 1
        x = w[i] ^ w[at]
        y = x | (x >> np.uint64(1))
        y = (y | (y >> np.uint64(2))) & np.uint64(0x1111111111111111)
        agree = 1 - np.bitwise_count(y).sum(axis=1) / HASHES
        yield i, at[(agree - 2.0**-BITS) / (1 - 2.0**-BITS) >= least_estimate(threshold)]


def _with_partners(group: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """The rows of a group that have any other close to them."""
    good = np.zeros(len(group), bool)
    for i, at in _close(group, threshold):
        good[at] = True
        good[i] |= len(at) > 0
    return group.loc[good, ["key", "i", "j", "own", "node", "component"]]


def _links_within(group: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Confirmed links of a group that join components; each pair is looked at in its first common band."""
    # A node of several sets comes with all of them; those that aren't in this bucket are looked at in theirs.
    group = group[[group["key"].iloc[0] in set(b) for b in group["bands"]]].reset_index(drop=True)
    bands, node, component, texts = np.stack(group["bands"].to_numpy()), group["node"].to_numpy(), group["component"].to_numpy(), group["text"].to_numpy()
    here = int(np.flatnonzero(bands[0] == group["key"].iloc[0])[0])
    parent, sets, links = {c: c for c in component}, {}, []

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def of(i):
        if i not in sets:
            sets[i] = shingle_sets(pa.array([texts[i]], pa.string()))[0]
        return sets[i]

    for i, at in _close(group, threshold):
        for j in at[(bands[i] == bands[at]).argmax(axis=1) == here].tolist():
            a, b = root(component[i]), root(component[j])
            if a != b and linked(of(i), of(j), threshold):
                parent[a] = b
                links.append((node[i], node[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (``doc_id``, ``text``; no other column is read).

    component_id is the smallest doc_id that links reach (the row's own without links), kept whether it is
    the row's own.  Null texts and texts without words have an empty set and no links.  Rows with one
    doc_id are one document, linked by any of its texts.  A row with a null doc_id is linked with nothing,
    has a null component_id and is kept.  An empty table gives no rows.
    """
    signed = stage_table(signatures(docs), "signatures")
    full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    equal = stage_table(full.groupBy("same").agg(F.min("doc_id").alias("node")), "equal-sets")
    member = stage_table(full.select("doc_id", "same").join(equal, "same").select("doc_id", "node"), "member-nodes")
    own = (full["same"] == equal["same"]) & (full["doc_id"] == equal["node"])  # at most once, so no key is hot
    # A doc_id of several texts may be the smallest of several sets; each is a row of its node, which is linked by any of them.
    nodes = full.join(equal, own).select("node", full["same"], "n_shingles", "bands", *_words()).dropDuplicates(["node", "same"]).drop("same")
    nodes = stage_table(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stage_table(banded.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = stage_table(banded.join(buckets, "key").select("node", "first").distinct(), "shared-buckets")
    stars = shared.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    # Only texts of nodes that share a bucket are needed again; the whole table is shuffled this once.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = stage_table(texts.join(shared.select("node").distinct().hint("shuffle_hash"), "node", "left_semi"), "texts")
    # Rows of one doc_id with different texts are one document, so a doc_id's nodes are linked with it.
    doubled = member.where("doc_id <> node").join(nodes.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = _confirmed(_screened(stars, nodes, threshold), texts, threshold).union(doubled)
    drop_tables(shared)
    more = _between_components(nodes, texts, components(links), buckets, threshold)
    label = components(links.union(more))
    per_doc = member.join(label, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    own_label = stage_table(per_doc.groupBy("doc_id").agg(F.min("component").alias("component_id")), "components")
    told = stage_table(signed.select("doc_id", "n_shingles"), "set-sizes")
    drop_tables(signed, equal, member, nodes, buckets, texts)
    labelled = told.where("doc_id IS NOT NULL").join(own_label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    unnamed = told.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return labelled.union(unnamed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``; of repeated rows of one doc_id the one of lowest hash stays.

    Rows with a null doc_id stay.  Texts are shuffled once, by doc_id.
    """
    kept = stage_table(near_copies(docs, threshold).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept")
    id_, nth = (free_name(docs, x) for x in ("near_doc_id", "near_nth"))
    named = docs.withColumn(id_, F.col("doc_id").cast("long")).where(F.col(id_).isNotNull())
    order = Window.partitionBy(id_).orderBy(F.xxhash64(*own_columns(docs)))
    rows = named.join(kept.withColumnRenamed("doc_id", id_), id_, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return rows.select(*own_columns(docs)).union(docs.where(F.col("doc_id").cast("long").isNull()))
