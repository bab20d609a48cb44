"""Free-text search by postings of trigrams kept beside the ledger.

A needle's literal runs of three characters or more must all occur in a row that matches, so the rows in the postings of
its rarest trigrams are the only candidates; the exact comparison then decides. A needle without such a run looks at every row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, like_ascii
from ..schema import POSTING
from .store import BucketTable, Store

COLUMNS = ["number_s", "seller_s", "buyer_s"]
#: Trigrams of a needle whose postings are read.
GRAMS = 3


def postings(ledger: DataFrame) -> DataFrame:
    """(gram, id): every run of three characters of the searched columns of a row once, A-Z folded; nothing is shuffled."""
    ends = F.array(*[fold_ascii(F.col(c)) for c in COLUMNS])
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda k: F.substring(t, k, F.lit(3)))
    grams = F.flatten(F.transform(F.filter(ends, lambda t: F.length(t) >= 3), runs))
    return ledger.select(F.explode(F.array_distinct(grams)).alias("gram"), "id")


def posting_table(store: Store) -> BucketTable:
    return store.table("postings", POSTING, ["gram", "id"], "gram", buckets=64)


def needle_grams(needle: str) -> list[str]:
    """The trigrams of the needle's literal runs; % and _ are wild."""
    folded = "".join(c.lower() if c.isascii() else c for c in needle.strip())
    return sorted({run[k : k + 3] for run in re.split("[%_]+", folded) for k in range(len(run) - 2)})


def search(ledger: DataFrame, index: BucketTable, needle: str) -> DataFrame:
    """The rows of the ledger in which a column holds the needle; blank needles hold everywhere."""
    word = needle.strip()
    if not word:
        return ledger
    exact = like_ascii(F.col(COLUMNS[0]), word)
    for c in COLUMNS[1:]:
        exact = exact | like_ascii(F.col(c), word)
    grams = needle_grams(word)
    if not grams:
        return ledger.where(exact)
    held = index.read_keys(ledger.sparkSession.createDataFrame([(g,) for g in grams], "gram string"))
    # no more numbers than the needle has characters
    sizes = {r["gram"]: r["count"] for r in held.groupBy("gram").count().collect()}
    rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:GRAMS]
    found = held.where(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(rarest)).select("id")
    return ledger.where(exact).join(found, "id", "left_semi")
