"""Near-duplicate titles: greedy clusters of a group, and corpus-wide pairs by banding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import hamming, simhash_bigint

PAGE_DISTANCE = 3
GROUP_DISTANCE = 12
BLOCK = 2_000


def greedy(hashes: np.ndarray, limit: int) -> np.ndarray:
    """Cluster number of each hash, in order: the first cluster with any member within ``limit`` bits, else a new one.

    A member that is near two clusters joins the first; clusters never merge.
    """
    labels = np.zeros(len(hashes), dtype=np.int64)
    count = 0
    for k, h in enumerate(hashes):
        near = labels[:k][np.bitwise_count(hashes[:k] ^ h) <= limit]
        if len(near):
            labels[k] = near.min()
        else:
            labels[k] = count
            count += 1
    return labels


def _clusters(df: DataFrame, by: list[str], order: list[str], ascending: bool, limit: int, hash_column: str, key: str) -> DataFrame:
    columns = [*by, key, *[o for o in order if o != key], hash_column]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=ascending, kind="stable").reset_index(drop=True)
        bits = pdf[hash_column].map(lambda x: int(x, 16)).to_numpy(dtype=np.uint64)
        pdf["cluster"] = greedy(bits, limit)
        pdf["is_first"] = ~pdf["cluster"].duplicated()
        pdf["cluster_size"] = pdf.groupby("cluster")["cluster"].transform("size")
        return pdf[[*by, key, "cluster", "is_first", "cluster_size"]]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*by, key]), "cluster long", "is_first boolean", "cluster_size long"])
    return df.select(*columns).groupBy(*by).applyInPandas(one, schema)


def collapse_pages(paged: DataFrame, limit: int = PAGE_DISTANCE) -> DataFrame:
    """Clusters within each page, newest first; the first member stands for its cluster."""
    return _clusters(paged, ["page"], ["place"], True, limit, "content_hash", "item_id").join(paged.select("page", "item_id", "place"), ["page", "item_id"])


def paginate(groups: DataFrame, order: list[Column], per_page: int = 20) -> DataFrame:
    """Collapsed groups with page and place: pages of groups rather than of items, for sets that are collapsed before they are paged."""
    from tidewheel.operators.trends import numbered

    rows = numbered(groups, order)
    return rows.withColumns({"page": F.floor((F.col("rn") - 1) / per_page) + 1, "place": (F.col("rn") - 1) % per_page + 1}).drop("rn")


def group_near_duplicates(items: DataFrame, by: list[str], limit: int = GROUP_DISTANCE) -> DataFrame:
    """Greedy clusters of each group in the order (published_at, item_id); groups are bounded sets such as a page or a window."""
    return _clusters(items, by, ["published_at", "item_id"], True, limit, "content_hash", "item_id")


def near_pairs(items: DataFrame, limit: int = PAGE_DISTANCE, key: str = "item_id", hash_column: str = "content_hash") -> DataFrame:
    """All pairs within ``limit`` bits, over the whole table.

    ``limit`` + 1 bands of 64 bits: two hashes within ``limit`` agree in one band at least, so an equi-join on (band, value) is
    exact; equal hashes are joined once per distinct hash, not once per row.

    Pairs of ids may be very many where many share a hash.  The ids of a hash stand in blocks of about ``BLOCK``, and two near
    hashes give a grid of cells, each of two blocks; a cell is one key of the last join, so no task has more than some cells.
    """
    bands = limit + 1
    width = 64 // bands
    rows = items.select(F.col(key).alias("id"), simhash_bigint(F.col(hash_column)).alias("h"))
    kinds = rows.select("h").distinct()

    def band(k: int) -> Column:
        bits = 64 - width * k if k == bands - 1 else width
        moved = F.shiftrightunsigned("h", width * k)
        return moved if bits == 64 else moved.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    cut = kinds.select("h", F.posexplode(F.array(*(band(k) for k in range(bands)))).alias("band", "value"))
    other = cut.select(F.col("h").alias("h2"), "band", "value")
    near = cut.join(other, ["band", "value"]).where((F.col("h") < F.col("h2")) & (hamming(F.col("h"), F.col("h2")) <= limit)).select("h", "h2").distinct()
    same = kinds.select("h", F.col("h").alias("h2"))
    sizes = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    both = near.unionAll(same).join(sizes, "h").join(sizes.select(F.col("h").alias("h2"), F.col("n").alias("n2")), "h2")
    rank = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = both.select("h", "h2", "n2", rank("n").alias("i")).select("h", "h2", "i", rank("n2").alias("j")).where("h <> h2 OR i <= j")
    placed = rows.join(sizes, "h").select("id", "h", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("i"))
    left = placed.withColumnRenamed("id", "a").join(cells, ["h", "i"])
    right = placed.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("i").alias("j")).join(cells, ["h2", "j"])
    pairs = left.join(right, ["h", "i", "h2", "j"]).where("a < b OR a > b AND (h <> h2 OR i <> j)")
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), hamming(F.col("h"), F.col("h2")).alias("distance"))
