"""Fingerprints of transactions: FNV-1a, 64 bits, over UTF-16 code units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import bucket_seconds, epoch_seconds
from .text import nfkc, normalize_counterparty, normalize_description, text, trim_all

VERSION = 2
WINDOW_MINUTES = 2
# fixed values: the FNV-1a offset basis and prime
BASIS, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


@F.pandas_udf(T.StringType())
def _fnv1a64(texts: pd.Series) -> pd.Series:
    """A batch at once: the states of all texts take the code unit of one place after another; the longest come first, so those still running stand in front."""
    there = texts.notna().to_numpy()
    raw = [x.encode("utf-16-le") for x in texts[there]]
    sizes = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
    units = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts, running = (np.cumsum(sizes) - sizes)[order], len(raw) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    state = np.full(len(raw), BASIS, np.uint64)
    for at, n in enumerate(running):
        state[:n] = (state[:n] ^ units[starts[:n] + at]) * PRIME  # modulo 2^64
    done = np.empty(len(raw), np.uint64)
    done[order] = state
    out = np.full(len(texts), None, object)
    out[there] = [f"{x:016x}" for x in done.tolist()]
    return pd.Series(out)


def fnv1a64(c: Column) -> Column:
    """16 lower-case hex digits.  One Arrow-batched function: a fold over the code units of each row, as an expression, isn't compiled and took half of a ledger's
    time."""
    return _fnv1a64(c)


def preimage(occurred_at: Column, amount_minor: Column, direction: Column, counterparty: Column, balance_after_minor: Column, order_id: Column, description: Column, fold=nfkc) -> Column:
    """What is hashed: the order id if there is one, else the balance, else a two-minute bucket with both texts."""
    v, bar = F.lit(f"v{VERSION}"), "|"
    order = trim_all(text(order_id))
    amount, epoch = amount_minor.cast("string"), epoch_seconds(occurred_at)
    by_order = F.concat_ws(bar, v, F.lit("ord"), order, amount, direction)
    by_balance = F.concat_ws(bar, v, F.lit("bal"), balance_after_minor.cast("string"), epoch.cast("string"), amount, direction)
    by_window = F.concat_ws(bar, v, F.lit("win"), bucket_seconds(epoch, WINDOW_MINUTES).cast("string"), amount, direction, normalize_counterparty(counterparty, fold), normalize_description(description, fold))
    return F.when(order != "", by_order).when(balance_after_minor.isNotNull(), by_balance).otherwise(by_window)
