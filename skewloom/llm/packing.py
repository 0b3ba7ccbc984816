"""Filling containers of fixed capacity with texts, by bounded-space online packing.

Each partition keeps a fixed number of open windows. An item goes to the open window that it fills
best; if it fits none, the fullest window is emitted and a new one opened. What is still open at the
end of a partition, and windows that are far from full, are packed once more in a few merge tasks.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Folder of the vocabulary files of public tokenizers; a parameter, as the files stay outside the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


#: Fixed value: the public pattern that splits text before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space from which the fast counter's pattern would overflow its stack.
LONG_SPACE = re.compile(r"\s{2000}")


@lru_cache(maxsize=4)
def token_counter(stem: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens, for the vocabulary in ``stem``.tiktoken and ``stem``.json.

    Both files hold the same vocabulary. The library of the first is several times faster, but fails
    on very long runs of white space; texts with one are counted by the other.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(f"{stem}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding(os.path.basename(stem), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []

    def count(text: str) -> int:
        if not LONG_SPACE.search(text):
            return len(encoding.encode_ordinary(text))
        if not slow:
            slow.append(Tokenizer.from_file(f"{stem}.json"))
            slow[0].encode_special_tokens = True
        return len(slow[0].encode(text, add_special_tokens=False).ids)

    return lambda texts: [count(t) for t in texts]


def token_sizes(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k") -> DataFrame:
    """(id, size): tokens of each whole text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "size": count(b["text"].tolist())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).where("id is not null").mapInPandas(run, f"id {kind}, size bigint")


#: Open windows of a merge task, which gets the leftovers of about half as many containers.
MERGE_WINDOWS = 4096


class Windows:
    """A fixed number of open windows; an item goes to the one that it fills best."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}
        self.opened = 0

    def add(self, item, size: int) -> Iterator[list]:
        """Places the item; gives the windows that are full or had to make room."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                yield self.held.pop(self.free.pop(0)[1])
            room, window = self.capacity, self.opened
            self.opened += 1
            self.held[window] = []
        self.held[window].append(item)
        if room == size:
            yield self.held.pop(window)
        else:
            insort(self.free, (room - size, window))

    def rest(self) -> Iterator[list]:
        """The windows still open, fullest first."""
        for _, window in self.free:
            yield self.held.pop(window)
        self.free = []


def pieces(ids: Iterable, sizes: Iterable[int], capacity: int) -> Iterator[tuple]:
    """(id, piece, size): an item above the capacity gives full pieces and a remainder, others one piece."""
    for i, size in zip(ids, sizes):
        for piece, begin in enumerate(range(0, size, capacity)):
            yield i, piece, min(capacity, size - begin)


def pack(sizes: DataFrame, capacity: int = 4096, open_windows: int = 64, full: float = 0.98, merge_tasks: int | None = None) -> DataFrame:
    """(container, id, piece, size, filled) of every item of (id, size) with a positive size.

    Only items above ``capacity`` are cut: into full pieces, numbered from 0, and a remainder. Windows
    filled below the share ``full`` when a partition ends or emits them are leftovers; their pieces
    are packed again, largest first within each of ``merge_tasks`` tasks. Items of size 0, and null
    sizes, need no container and are left out. Repeated ids are packed as often as they occur. The
    first pass is written, so that a repeated task cannot give its containers other contents.
    """
    kind = dict(sizes.dtypes)["id"]
    schema = f"container string, id {kind}, piece int, size bigint, filled bigint"

    def emit(tag: str, windows: Iterable[list]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for k, items in enumerate(windows):
            filled = sum(x[2] for x in items)
            rows += ((f"{tag}-{k}" if filled >= full * capacity or tag[0] == "m" else None, *x, filled) for x in items)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["container", "id", "piece", "size", "filled"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["container", "id", "piece", "size", "filled"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        windows = Windows(capacity, open_windows)
        items = (x for b in batches for x in pieces(b["id"], b["size"].astype(int), capacity))
        yield from emit(f"p{TaskContext.get().partitionId()}", _through(windows, items))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        windows = Windows(capacity, MERGE_WINDOWS)
        items = (x for b in batches for x in zip(b["id"], b["piece"], b["size"]))
        yield from emit(f"m{TaskContext.get().partitionId()}", _through(windows, items))

    placed = written(sizes.where("size > 0").select("id", "size").mapInPandas(first, schema))
    over = placed.where("container is null").select("id", "piece", "size")
    if merge_tasks is None:
        room = placed.where("container is null").agg(F.sum("size")).first()[0] or 0
        merge_tasks = max(1, int(room // (capacity * 2000)))
    spread = over.repartition(merge_tasks, F.xxhash64("id", "piece")).sortWithinPartitions(F.col("size").desc(), "id", "piece")
    return placed.where("container is not null").unionByName(spread.mapInPandas(second, schema))


def _through(windows: Windows, items: Iterable[tuple]) -> Iterator[list]:
    for x in items:
        yield from windows.add(x, int(x[2]))
    yield from windows.rest()


def oversized(packed: DataFrame) -> DataFrame:
    """(id): items that got more than one container because they exceed one."""
    return packed.where("piece > 0").select("id").distinct()
