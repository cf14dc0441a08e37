"""Near-duplicate detection with circulant MinHash, banding and exact verification.

Signatures need two permutations only: one deals shingle hashes over a domain, the other, stored
as a table and shifted by one place for each coordinate, ranks the domain. So the ranks of a
shingle under all coordinates lie side by side in the table.

1. One pass over the texts gives each document its set size, a BLAKE2b-128 name of its sorted set and
   its bands. Documents with equal sets form a class, represented by its first document. A coordinate is
   the shingle that has the least rank, not the rank: in long texts the least ranks are a handful of small
   numbers that unlike texts share.
2. Representatives that share a band are candidates. They are tested in rounds: first each with
   its band's hub, the member that shares most bands with most others, then, in bands whose members
   are not yet connected, with more hubs. So pairs inside a connected group are not made. What is
   left in unconnected bands has been found unlike its hubs; there every remaining pair is covered by
   prefixes: two sets that are alike enough share one of the rarest shingles of each (as many as may be
   missing, and one more), so only pairs that share such a shingle are tested. No partner is dropped.
3. A pair is a link if 100 * |A and B| >= 75 * |A or B| on the full sets. Components follow from
   label propagation with pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import forget, free_name, materialise, with_row_key

BANDS = 40
BAND_ROWS = 4
DOMAIN_BITS = 18
#: Bits of the shingle's own hash below its rank in a coordinate.
OWN_BITS = 32 - DOMAIN_BITS
#: Hubs of a band that its members are tested with, round by round, before what is left follows by its rarest shingles.
HUBS = (1, 4)
ROWS_AT_ONCE = 256
_U = np.uint64


class CirculantMinHash:
    """Band keys of sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.size = bands, rows, bands * rows
        ranks = rng.permutation(1 << DOMAIN_BITS).astype(np.uint32) << np.uint32(OWN_BITS)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: self.size]]), self.size)
        self.deal = _U(int(rng.integers(1 << 62)) * 2 + 1)
        self.salt = rng.integers(1 << 63, size=bands, dtype=np.int64).astype(np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sets), self.size), np.iinfo(np.uint32).max, np.uint32)
        filled = [i for i, s in enumerate(sets) if len(s)]
        if not filled:
            return out
        with np.errstate(over="ignore"):
            dealt = np.concatenate([sets[i] for i in filled]) * self.deal
        places = (dealt >> _U(64 - DOMAIN_BITS)).astype(np.int64)
        own_bits = (dealt >> _U(64 - DOMAIN_BITS - OWN_BITS) & _U((1 << OWN_BITS) - 1)).astype(np.uint32)[:, None]
        owner = np.repeat(np.array(filled), [len(sets[i]) for i in filled])
        for at in range(0, len(places), 4096):
            own = owner[at : at + 4096]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ranks = self.shifted[places[at : at + 4096]]
            ranks |= own_bits[at : at + 4096]
            least = np.minimum.reduceat(ranks, cut, axis=0)
            out[own[cut]] = np.minimum(out[own[cut]], least)
        return out

    def band_keys(self, sets: list[np.ndarray]) -> np.ndarray:
        from quarrymill.llm.hashing import mix

        parts = self.signatures(sets).astype(np.uint64).reshape(len(sets), self.bands, self.rows)
        key = np.broadcast_to(self.salt, (len(sets), self.bands)).copy()
        for r in range(self.rows):
            key = mix(key ^ parts[:, :, r])
        return key.view(np.int64)


def sketch(docs: DataFrame, row: str, text: str, *, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """row, n_shingles, the name of the set, and bands (null for an empty set) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarrymill.llm import hashing

        minhash = CirculantMinHash(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sets = [hashing.shingles(w) for w in hashing.words_of(x.as_py() for x in part.column(1))]
                keys = minhash.band_keys(sets)
                n = [len(s) for s in sets]
                names = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array([k if m else None for k, m in zip(keys, n, strict=True)], pa.list_(pa.int64()))], ["row", "n_shingles", "name", "bands"])

    return docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(run, "row long, n_shingles long, name binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """row, text to node, set: the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarrymill.llm import hashing

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sets = [hashing.shingles(w).view(np.int64) for w in hashing.words_of(x.as_py() for x in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return docs.select("row", "text").mapInArrow(run, "node long, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label (written): the least node of each component of the undirected edges (a, b)."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near.hint("merge"), label["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialise(step.join(jump.hint("merge"), "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        forget(label)
        if step.where("label != old").isEmpty():
            forget(both)
            return step
        label = step


def near_duplicates(docs: DataFrame, *, row: str, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Components of documents whose five-word shingle sets are alike by `percent` or more.

    `docs` must have a unique long `row` and be replayable. Returns for each row: row, doc_id,
    n_shingles, component_row (the first row of the component) and component_id (its least
    doc_id, null if all are null). Null, empty and wordless texts have no shingles and stand
    alone. Repeated rows are linked like any equal texts. Without rows there is no result row.
    The chance to miss a link between two sets at 75 % is (1 - 0.75**4)**40 = 2.5e-7 before the prefix step.

    Joins are of sides that grow with the corpus, so they are hinted to sort and merge at every size; AQE splits
    a key that many rows share. What a key of a band comes to (count, hubs, labels) is aggregated before the shuffle.
    """
    source = docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = materialise(sketch(source, "row", "text"), "sketch")
    full = base.where("n_shingles > 0")
    classes = materialise(full.groupBy("name").agg(F.min("row").alias("node"), F.min_by("bands", "row").alias("bands"), F.first("n_shingles").alias("n")), "classes")

    members = classes.select("node", "n", F.explode("bands").alias("key"))
    keys = members.groupBy("key").agg(F.count("*").alias("n_members")).where("n_members > 1")
    shared = materialise(members.join(keys.hint("merge"), "key"), "shared-bands")
    # How many others a node meets in its bands: the middle of a family of edited copies has most.
    label = materialise(shared.groupBy("node").agg(F.sum("n_members").alias("score"), F.col("node").alias("label")), "labels")
    sets = materialise(_sets(source.join(label.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")), "sets")

    def fits(a: str, b: str) -> str:
        """Sets whose sizes differ more can't reach the share."""
        return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge")
        two = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge")
        both = F.size(F.array_intersect("set_a", "set_b"))
        tested = pairs.join(one, "a").join(two, "b").withColumn("both", both)
        return tested.where(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")

    def rare(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, other) pairs of different labels whose sets share one of the rarest shingles of each, and the table they are made from."""
        said = sets.join(rest.hint("merge"), "node").select("node", "label", F.size("set").alias("n"), F.explode("set").alias("shingle"))
        seen = said.groupBy("shingle").agg(F.count("*").alias("seen"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        seen = seen.select("shingle", "seen", (F.col("lo") != F.col("hi")).alias("split"))
        ordered = said.join(seen.hint("merge"), "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "shingle", "split"))).alias("all"))
        prefix = ordered.select("node", "label", "n", F.posexplode(F.expr(f"slice(all, 1, n - cast(ceil({percent} * n / 100) as int) + 1)")).alias("at", "x"))
        prefix = materialise(prefix.where("x.split").select("node", "label", "n", "at", F.col("x.shingle").alias("shingle")), "prefixes")
        other = prefix.select("shingle", F.col("node").alias("other"), F.col("label").alias("label_o"), F.col("n").alias("n_o"), F.col("at").alias("at_o")).hint("merge")
        # What can still be shared from here on must be enough.
        enough = f"least(n - at, n_o - at_o) * {100 + percent} >= {percent} * (n + n_o)"
        return prefix.join(other, "shingle").where("node > other and label != label_o").where(fits("n", "n_o")).where(enough).select("node", "other"), prefix

    tested: list[DataFrame] = []
    for turn, hubs in enumerate([*HUBS, None]):
        now = materialise(shared.join(label.hint("merge"), "node").select("key", "node", "n", "label", "score"), "labelled-bands")
        order = [F.col("score") * (1 + F.pmod(F.xxhash64("node", F.lit(turn), F.lit(i)), F.lit(1000)) / 4000 * min(turn, 1)) for i in range(hubs or 0)]
        best = [F.max(F.struct(o.alias("order"), F.col("node").alias("other"), F.col("label").alias("label_o"), F.col("n").alias("n_o"))) for o in order]
        split = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*best).alias("hubs")).where("lo != hi")
        made = []
        if hubs is None:
            pairs, prefix = rare(now.join(split.select("key").hint("merge"), "key", "left_semi").select("node", "label").distinct())
            made = [prefix]
        else:
            met = now.join(split.select("key", F.explode("hubs").alias("hub")).hint("merge"), "key").select("node", "n", "label", "hub.*")
            pairs = met.where("label != label_o").where(fits("n", "n_o"))
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        for before in tested:
            pairs = pairs.join(before.hint("merge"), ["a", "b"], "left_anti")
        tested.append(materialise(pairs, "pairs"))
        forget(now, *made)
        links = materialise(verified(tested[-1]), "links")
        named = links
        for end in ("a", "b"):
            named = named.join(label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")).hint("merge"), end)
        merged = components(named.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        least = merged.select(F.col("node").alias("label"), F.col("label").alias("least")).hint("merge")
        new = materialise(label.join(least, "label", "left").select("node", "score", F.coalesce("least", "label").alias("label")), "labels")
        forget(label, links, merged)
        label = new
    forget(shared, sets, *tested)

    # Where a document's class goes, then the least id and the first row of each component.
    of_class = classes.select("name", "node").join(label.select("node", "label").hint("merge"), "node", "left").select("name", F.coalesce("label", "node").alias("label"))
    joined = base.select("row", "n_shingles", "name").join(of_class.hint("merge"), "name", "left").select("row", "n_shingles", F.coalesce("label", "row").alias("label"))
    named = materialise(joined.join(source.select("row", "doc_id").hint("merge"), "row"), "components")
    forget(base, classes, label)
    first = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = materialise(first.select("label", "component_id", F.col("first.row").alias("component_row")), "first")
    return named.join(first.hint("merge"), "label").select("row", "doc_id", "n_shingles", "component_row", "component_id")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null, empty and wordless texts have n_shingles 0 and stand alone. A null doc_id is the least only where the whole component
    has no other; then component_id is null and kept true. Rows that share a doc_id are rows of their own. No rows, no result rows.
    """
    found = near_duplicates(with_row_key(docs.select("doc_id", "text"), "row"), row="row")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, one from each component: that with the least doc_id (null last; of equal ids the first row).

    Rows without words all stay. `docs` must be replayable. No rows, no result rows.
    """
    row = free_name(docs, "dup_row")
    keyed = with_row_key(docs, row)
    kept = near_duplicates(keyed, row=row, **options).where("row = component_row").select("row")
    return keyed.join(kept, keyed[row] == kept["row"], "left_semi").select(*docs.columns)
