"""Problem 8: documents packed into requests of fixed capacity.

Method: sum-of-squares packing. Each document goes where the squared counts of open requests per
remaining gap become smallest, into an open request or a new one. A document larger than one request
fills whole requests, and its rest is packed like any other. Packing is sequential, so documents are
dealt by hash into groups of bounded size that are packed side by side; what the last requests of a
group leave open is small beside a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.plans.lineage import keep, spread, width

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
GROUP = 10_000
#: Texts are tokenized in parts of about this many characters, cut at blanks, to bound memory.
BATCH_CHARS = 4_000_000
OUT = "provider string, request long, doc_id long, part int, from_token long, tokens long"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``tokens``: length of each text in tokens of the public tokenizer at ``path``; 0 for a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for pdf in batches:
            counts, lengths = [], pdf["text"].str.len().to_numpy()
            cuts = np.nonzero(np.diff(np.cumsum(lengths) // BATCH_CHARS, prepend=-1))[0].tolist() + [len(pdf)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                counts += [len(e.ids) for e in tok.encode_batch_fast(pdf["text"].iloc[lo:hi].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": counts})

    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return rows.mapInPandas(run, "doc_id long, tokens long")


def pack(sizes: np.ndarray, capacity: int) -> tuple[list[int], int]:
    """Bin of each size (1 to ``capacity``) by the sum-of-squares rule, and the number of bins."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    cost = np.empty(capacity + 1, np.float64)
    where, made = [], 0
    for s in sizes.tolist():
        # change of the sum when a request of gap g becomes one of gap g - s; full ones leave the sum
        best = cost[s:]
        np.subtract(n[: capacity + 1 - s], n[s:], out=best, casting="unsafe")
        best[0] = -n[s] - 0.5
        best[n[s:] == 0] = np.inf
        g = int(best.argmin()) + s
        fresh = n[capacity - s] + 0.5 if s < capacity else 0.0
        if best[g - s] + 0.5 <= fresh and n[g]:
            b = open_bins[g].pop()
            n[g] -= 1
        else:
            b, g = made, capacity
            made += 1
        if g > s:
            open_bins[g - s].append(b)
            n[g - s] += 1
        where.append(b)
    return where, made


def _packer(limits: list[tuple[str, int]]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        ids, sizes, out = pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy(), []
        base = int(key[0]) << 32
        for capacity in sorted({c for _, c in limits}):
            whole, rest = sizes // capacity, sizes % capacity
            rest = np.where((sizes == 0), 1, rest)  # an empty document takes a place of its own size, one
            packed = rest > 0
            bins, made = pack(rest[packed], capacity)
            first = np.concatenate([[0], np.cumsum(whole)])[:-1] + made
            full = np.repeat(np.arange(len(ids)), whole)
            part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            a = pd.DataFrame({"request": base + first[full] + part, "doc_id": ids[full], "part": part, "from_token": part * capacity, "tokens": capacity})
            b = pd.DataFrame({"request": base + np.array(bins, np.int64), "doc_id": ids[packed], "part": whole[packed], "from_token": whole[packed] * capacity, "tokens": np.where(sizes == 0, 0, rest)[packed]})
            out += [x.assign(provider=p) for x in (a, b) for p, c in limits if c == capacity]
        return pd.concat(out)[["provider", "request", "doc_id", "part", "from_token", "tokens"]] if out else pd.DataFrame(columns=["provider", "request", "doc_id", "part", "from_token", "tokens"])

    return run


def requests(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """``provider``, ``request``, ``doc_id``, ``part``, ``from_token``, ``tokens``: the request of each document, or of its parts.

    Only a document larger than one request has parts. Null and blank documents take part with 0
    tokens. Limits that are null or below 1 and repeated ones make no requests of their own. Every
    provider is a result of its own for all documents, so their list is short against the result.
    """
    asked = [(r.provider, int(r.max_tokens)) for r in limits.filter("max_tokens >= 1").groupBy("provider").agg(F.min("max_tokens").alias("max_tokens")).collect()]
    sized = keep(token_counts(docs, id_col, text, path))
    groups = max(1, -(-sized.count() // group))
    dealt = sized.withColumn("h", F.xxhash64("doc_id")).withColumn("group", F.pmod("h", F.lit(groups)))
    # A number of partitions of its own, since adaptive execution would put the small groups into one task.
    return dealt.repartition(max(width(docs.sparkSession), 4 * groups), "group").groupBy("group").applyInPandas(_packer(asked), OUT)


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """``provider``, ``requests``, ``documents``, ``tokens``, ``fill``: how well the requests are used."""
    by = packed.groupBy("provider").agg(F.countDistinct("request").alias("requests"), F.countDistinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"))
    room = limits.filter("max_tokens >= 1").groupBy("provider").agg(F.min("max_tokens").alias("max_tokens"))
    return by.join(room, "provider").select("provider", "requests", "documents", "tokens", (F.col("tokens") / (F.col("requests") * F.col("max_tokens"))).alias("fill"))
