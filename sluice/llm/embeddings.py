"""Embedding near-dedup by cross-polytope hashing.

A vector is normalised, padded to a power of two and rotated by random signs and fast Hadamard transforms,
three times.  Its hash is the nearest signed axis.  ``HASHES`` rotations make one table's bucket, ``TABLES``
tables are used, and each vector also looks into the ``PROBES`` buckets that its runner-up axes
make likeliest.  At cosine 0.95 in 64 dimensions, one direction of that finds 99.9 % of the pairs; either direction is
enough.  128**HASHES buckets should be some hundred times the number of different vectors.

Exact copies are one node.  In a bucket every vector is first compared with the bucket's smallest one; only
vectors that this leaves in different components are compared further, tile against tile, and a tile pair
returns the components it joins, never its pairs.  Links are then counted exactly inside components (a link cannot
leave one), again tile against tile with one count per vector and tile.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import lists, mix, signed
from sluice.llm.components import components, extended
from sluice.llm.scratch import Scratch

HASHES, TABLES, PROBES, SEED = 3, 8, 8, 20240229
#: Vectors on one side of a tile.
TILE = 512
#: Members of a bucket up to which its pairs are listed.
FEW = 16
_RUNNERS = 4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    rows = np.asarray(rows, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(x: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, probes) 64-bit keys of unit vectors; the first of each table is the vector's own bucket."""
    n, d = x.shape
    wide = np.zeros((n, 1 << max(0, (d - 1).bit_length())))
    wide[:, :d] = x
    size = wide.shape[1]
    rng = np.random.default_rng([SEED, d])
    runners = min(_RUNNERS, size)
    choices = np.array(list(itertools.product(range(runners), repeat=hashes)))
    take = min(probes, len(choices))
    out = np.zeros((n, tables, take), dtype=np.uint64)
    for t in range(tables):
        loss = np.zeros((n, len(choices)))
        code = np.zeros((n, len(choices)), dtype=np.uint64)
        for k in range(hashes):
            turned = wide
            for signs in rng.choice([-1.0, 1.0], size=(3, size)):
                turned = hadamard(turned * signs)
            axis = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :runners]
            value = np.take_along_axis(turned, axis, axis=1)
            named = (2 * axis + (value < 0)).astype(np.uint64)
            gap = value[:, :1] ** 2 - value ** 2
            loss += gap[:, choices[:, k]]
            code = code * np.uint64(2 * size) + named[:, choices[:, k]]
        best = np.argsort(loss, axis=1, kind="stable")[:, :take]
        out[:, t] = mix(np.take_along_axis(code, best, axis=1) + mix(np.uint64([(d << 8) + t + 1])))
    return out


def _keys(hashes, tables, probes):
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            vec = batch.column("vec")
            flat, width = vec.flatten().to_numpy(), np.diff(vec.offsets.to_numpy())
            first = np.concatenate(([0], np.cumsum(width)))
            for d in np.unique(width):
                rows = np.flatnonzero(width == d)
                for part in np.array_split(rows, max(1, len(rows) // 2000)):
                    x = unit(flat[first[part][:, None] + np.arange(d)])
                    keys = bucket_keys(x, hashes, tables, probes)
                    each = keys.shape[1] * keys.shape[2]
                    own = np.zeros(keys.shape[1:], dtype=bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part]), lists(signed(keys.reshape(-1)), np.arange(len(part) + 1) * each, pa.int64()),
                         lists(np.tile(own.reshape(-1), len(part)), np.arange(len(part) + 1) * each, pa.bool_())],
                        names=["id", "keys", "own"])
    return run


def _stack(column) -> np.ndarray:
    return unit(np.stack(column.to_numpy()))


def _close(threshold):
    def run(frames):
        for f in frames:
            if len(f):
                same = (f["va"].str.len() == f["vb"].str.len()).to_numpy()
                f = f[same]
            if len(f):
                ok = np.concatenate([(_stack(g["va"]) * _stack(g["vb"])).sum(axis=1) >= threshold if len(g) else []
                                     for _, g in f.groupby(f["va"].str.len(), sort=False)])
                f = pd.concat([g for _, g in f.groupby(f["va"].str.len(), sort=False)])
                yield f.loc[ok, ["a", "b"]]
    return run


def _join_labels(threshold):
    """Of two tiles of one bucket, the pairs of unlike labels that a link joins, each once."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        cos = _stack(left["vec"]) @ _stack(right["vec"]).T >= threshold
        i, j = np.nonzero(cos)
        a, b = left["label"].to_numpy()[i], right["label"].to_numpy()[j]
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()
    return run


def _count_links(threshold):
    """Of two tiles of one component, each vector's links into the other tile, copies counted."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        link = _stack(left["vec"]) @ _stack(right["vec"]).T >= threshold
        if key[1] == key[2]:
            np.fill_diagonal(link, False)
        to_left = link @ right["copies"].to_numpy()
        if key[1] == key[2]:
            return pd.DataFrame({"id": left["id"].to_numpy(), "links": to_left})
        return pd.DataFrame({"id": np.concatenate([left["id"], right["id"]]),
                             "links": np.concatenate([to_left, link.T @ left["copies"].to_numpy()])})
    return run


def _tile_pairs(rows: DataFrame, group: str, keep: Scratch, roles: tuple[str, str] | None) -> DataFrame:
    """Each row once for every tile that its own tile meets: (group, t0, t1, side, rest).

    ``roles`` names a condition per side; without it each unordered pair of tiles meets once.
    """
    count = keep.keep(rows.groupBy(group).agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    dealt = rows.join(count, group).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    out = []
    for side, (own, other) in enumerate((("t0", "t1"), ("t1", "t0"))):
        mine = dealt if roles is None else dealt.where(roles[side])
        met = every if roles else (F.sequence(F.col("t"), F.col("tiles") - 1) if side == 0 else F.sequence(F.lit(0).cast("long"), F.col("t")))
        out.append(mine.withColumn(other, F.explode(met)).withColumnRenamed("t", own).withColumn("side", F.lit(side)).drop("tiles"))
    return out[0].unionByName(out[1])


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                         hashes: int = HASHES, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; two link if their cosine is ``threshold`` or more.

    Null, empty and zero vectors, and vectors with null or non-finite parts, link with nothing.  Vectors of different
    lengths never link.  Repeated rows each get a result row and link with each other; of different vectors
    under one id one stands for the id.  Without an id, component_id and kept are null.
    """
    keep = Scratch(vectors.sparkSession, "embeddings")
    rows = keep.keep(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    tagged = rows.select("id", F.when(usable, F.col("vec")).alias("vec"))
    valid = tagged.where("vec IS NOT NULL")
    copies = keep.keep(valid.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    points = keep.keep(copies.select(F.col("rep").alias("id"), "copies", "vec").dropDuplicates(["id"]))

    hashed = points.select("id", "vec").mapInArrow(_keys(hashes, tables, probes), "id long, keys array<long>, own array<boolean>")
    keys = keep.keep(hashed.select("id", F.explode(F.arrays_zip("keys", "own")).alias("k")).select(
        "id", F.col("k.keys").alias("key"), F.col("k.own").alias("own")))
    shared = keys.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("id"))).alias("hub"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    blocks = keep.keep(keys.join(keep.keep(shared.where("hub IS NOT NULL AND lo < hi").select("key", "hub")), "key"))
    star = keep.keep(blocks.where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    va, vb = (points.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab")
    links = keep.keep(star.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInPandas(_close(threshold), "a long, b long"))
    labels = keep.keep(components(links, keep))

    member = keep.keep(blocks.join(labels, blocks["id"] == labels["node"], "left").select(
        "key", "id", "own", F.coalesce("component", "id").alias("label")))
    mixed = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    rest = keep.keep(member.join(keep.keep(mixed.select("key", "size")), "key"))
    # Buckets of a few vectors, mostly chance meetings, give their pairs; larger ones go tile against tile.
    few = rest.where(F.col("size") <= FEW)
    mine = few.where("own").select("key", F.col("id").alias("a"), F.col("label").alias("la"))
    met = mine.join(few.select("key", F.col("id").alias("b"), F.col("label").alias("lb")), "key").where("la != lb")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    close = keep.keep(met.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInPandas(_close(threshold), "a long, b long"))
    name = {c: labels.select(F.col("node").alias(c), F.col("component").alias(f"l{c}")) for c in "ab"}
    joins = close.join(name["a"], "a", "left").join(name["b"], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    many = rest.where(F.col("size") > FEW).drop("size").join(points.select("id", "vec"), "id")
    more = _tile_pairs(keep.keep(many), "key", keep, ("own", "true")).groupBy("key", "t0", "t1").applyInPandas(_join_labels(threshold), "a long, b long")
    labels = keep.keep(extended(labels, keep.keep(joins.unionByName(more).distinct()), keep))

    family = keep.keep(points.join(labels, points["id"] == labels["node"]).select("component", "id", "copies", "vec"))
    counted = _tile_pairs(family, "component", keep, None).groupBy("component", "t0", "t1").applyInPandas(
        _count_links(threshold), "id long, links long")
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    node = points.select("id", "copies").join(labels, points["id"] == labels["node"], "left").join(keep.keep(counted), "id", "left").select(
        F.col("id").alias("rep"), F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    rep = copies.select(F.xxhash64("vec").alias("h"), F.col("vec").alias("rep_vec"), "rep").join(keep.keep(node), "rep")
    out = tagged.withColumn("h", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).join(
        keep.keep(rep).withColumnRenamed("h", "rep_h"), (F.col("h") == F.col("rep_h")) & (F.col("vec") == F.col("rep_vec")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
