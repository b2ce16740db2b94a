"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by length to context-size tiers (2048, 1024, 512, 256 ids).
Each tier is packed from the longest down; what is left open in a window is filled
from the shorter tiers, whole pieces first and then one piece cut to the exact gap,
so that windows end up full. Windows of a tier are dealt to step groups of equal id
count, balanced by attention cost.

One pass, no shuffle: every input partition packs its own documents in blocks of
bounded size, so memory does not depend on the size of a partition and a lost task
is simply run again over the same rows.

Defined cases: a null text is the empty text and yields only the end id; repeated
rows are packed as often as they occur; a null ``doc_id`` is carried through; an
empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Context sizes, longest first: powers of two, which need no padding when full.
TIERS = (2048, 1024, 512, 256)
#: The id that ends every document.
END_ID = 1
#: Ids that are packed together; bounds the memory of a task.
BLOCK_IDS = 1 << 21
#: Ids of one step group, in windows of one size.
STEP_IDS = 64 * 2048

_MARKS = ".,;:!?*#$%&|"
#: The last character up to which any two versions of Unicode agree on what a letter is.
_SURE = "\u052f"
_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
Piece = tuple[int, int, int]  # document, start, length


#: Normaliser and pre-tokeniser of a tokenizer that may be asked chunk by chunk. Fixed values.
_FOLDED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_chunk(tokenizer) -> bool:
    """True if case is folded, white space dropped, and letters, digits and marks are parted before ids are found."""
    known = json.loads(tokenizer.to_str())
    folds, parts = known.get("normalizer") or {}, known.get("pre_tokenizer") or {}
    first = (parts.get("pretokenizers") or [{}])[0]
    parted = first.get("type") == "Split" and first.get("pattern") == {"Regex": _PARTED} and first.get("behavior") == "Removed" and first.get("invert")
    # Strings of added tokens would be found in a text, across chunks, if they held letters or white space alone.
    plain = all(t["content"].startswith("<|") and t["content"].endswith("|>") and " " not in t["content"] for t in known.get("added_tokens") or [])
    return bool(folds.get("normalizers") == _FOLDED and parted and plain)


class _Chunks:
    """Ids, as little-endian 32-bit bytes, of texts by way of their chunks between white space.

    A tokenizer of the kind ``by_chunk`` drops white space and never joins across it, so a
    text's ids are those of its chunks in order. It also folds case and parts letters from
    other marks, so the ids of a chunk of letters and then plain marks are those of both.
    Words repeat, and are kept in two generations of bounded size: what is used again
    moves to the younger one. Any other tokenizer encodes whole texts.
    """

    limit = 1 << 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = by_chunk(self.tokenizer)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

    def rest(self) -> None:
        """Keep less between partitions: the worker may do other work next."""
        self.old = {}
        pa.default_memory_pool().release_unused()

    def _encode(self, piece: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4")

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Words are encoded together, and told apart by the ids that end one."""
        words = [x for x in pieces if x.isalpha() and (x.isascii() or max(x) <= _SURE)]
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = self._encode(" ".join(some))
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) == len(some) and after[-1] == len(ids):
                data, ends = ids.tobytes(), (4 * after).tolist()
                found.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for x in pieces:
            if x not in found:
                found[x] = self._encode(x).tobytes()
        return found

    def _known(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.young.get, pieces))
        new = [x for x, ids in zip(pieces, found, strict=True) if ids is None]
        if new:
            late = {x: self.old[x] for x in new if x in self.old}
            late |= self._encoded([x for x in new if x not in late])
            found = [late[x] if ids is None else ids for x, ids in zip(pieces, found, strict=True)]
            short = {x: ids for x, ids in late.items() if len(x) <= 64}
            if len(self.young) + len(short) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update(itertools.islice(short.items(), self.limit))
        return found

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; each distinct word or run of marks of them all is looked up once."""
        if not self.chunked:
            return [self._encode(x).tobytes() for x in texts.to_pylist()]
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = _halves(coded.dictionary).dictionary_encode()
        known = self._known(pieces.dictionary.to_pylist())
        data, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        # First the ids of each chunk, those of its two halves, then those of all chunks in order.
        data, size = _gathered(data, size, pieces.indices.to_numpy())
        size = size.reshape(-1, 2).sum(1)
        data, size = _gathered(data, size, coded.indices.to_numpy())
        after = np.concatenate([[0], np.cumsum(size)])
        ends = after[np.cumsum([0, *pc.list_value_length(lists).to_numpy()])] * 4
        whole = data.tobytes()
        return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _halves(chunks: pa.Array) -> pa.Array:
    """Each chunk as a word and the plain marks after it, two strings; other chunks are whole, with an empty one."""
    chunks = chunks.cast(pa.string())
    cores = pc.utf8_rtrim(chunks, characters=_MARKS)
    plain = pc.and_(pc.utf8_is_alpha(cores), pc.invert(pc.match_substring_regex(cores, f"[^\\x{{0}}-\\x{{{ord(_SURE):x}}}]"))).to_numpy(zero_copy_only=False)
    begin = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1] if len(chunks) else np.zeros(1, np.int32)
    offsets = np.empty(2 * len(chunks) + 1, np.int32)
    offsets[::2] = begin
    offsets[1::2] = np.where(plain, begin[:-1] + pc.binary_length(cores).to_numpy(), begin[1:])
    halves = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), chunks.buffers()[2] if len(chunks) else pa.py_buffer(b""))
    return pc.if_else(pa.array(np.repeat(plain, 2)), pc.ascii_lower(halves), halves)


def _gathered(data: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``data``, which have these sizes, in the order of ``which``, and their sizes."""
    first, count = (np.cumsum(size) - size)[which], size[which]
    after = np.cumsum(count)
    total = int(after[-1]) if len(after) else 0
    return data[np.repeat(first - (after - count), count) + np.arange(total)], count


_loaded: dict[str, _Chunks] = {}


def chunks(path: str) -> _Chunks:
    """The chunk table of a tokenizer file, one for each worker process."""
    if path not in _loaded:
        _loaded[path] = _Chunks(path)
    return _loaded[path]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows ``(size, pieces)`` that hold every id of documents of these lengths once.

    All windows are full. The last open window of a block, if its ids do not fill it,
    is cut into full windows of smaller powers of two.
    """
    longest = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def tier_of(n: int) -> int:
        return min(t for t in tiers if t >= n)

    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pools[tier_of(n - whole)].append((n - whole, doc, whole))
    for t in tiers:
        pools[t].sort()
    for t in tiers:
        own = pools[t]
        short = sorted(x for s in tiers if s < t for x in pools[s])
        while own:
            n, doc, at = own.pop()
            pieces, gap = [(doc, at, n)], t - n
            while gap:
                pool = short or own
                if not pool:
                    break
                k = bisect_left(pool, (gap + 1,))
                if k:
                    n, doc, at = pool.pop(k - 1)
                    pieces.append((doc, at, n))
                    gap -= n
                else:
                    n, doc, at = pool.pop(0)
                    pieces.append((doc, at, gap))
                    insort(pool, (n - gap, doc, at + gap))
                    gap = 0
            windows += [(t, pieces)] if not gap else _binary(pieces)
        for s in tiers:
            if s < t:
                pools[s] = []
        for x in short:
            pools[tier_of(x[0])].append(x)
        for s in tiers:
            pools[s].sort()
    return windows


def _binary(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Pieces cut into windows of falling powers of two, without padding."""
    left, out = sum(n for *_, n in pieces), []
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        room, own = size, []
        while room:
            doc, at, n = pieces.pop()
            if n > room:
                pieces.append((doc, at + room, n - room))
                n = room
            own.append((doc, at, n))
            room -= n
        out.append((size, own))
        left -= size
    return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_ids: int = STEP_IDS) -> list[int]:
    """A step group for each window: one size and equal id counts to a group, costs balanced.

    The cost of a window is the sum of its pieces' squared lengths. Windows are dealt
    by falling cost, to and fro.
    """
    by_size: dict[int, list[int]] = {}
    for k, (size, _) in enumerate(windows):
        by_size.setdefault(size, []).append(k)
    groups, first = [0] * len(windows), 0
    for size in sorted(by_size, reverse=True):
        own = sorted(by_size[size], key=lambda k: (-sum(n * n for *_, n in windows[k][1]), k))
        many = -(-len(own) * size // step_ids)
        for rank, k in enumerate(own):
            lap, at = divmod(rank, many)
            groups[k] = first + (many - 1 - at if lap % 2 else at)
        first += many
    return groups


def _slices(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about ``most`` bytes together, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _packed(path: str, tiers: tuple[int, ...], block_ids: int, step_ids: int):
    schema = pa.schema(
        [(n, pa.int32() if n == "tier" else pa.int64()) for n in (x.split()[0] for x in _SCHEMA.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(path)
        end = END_ID.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 33
        docs: list[tuple[int | None, bytes]] = []
        held = sequences = groups = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, groups
            windows = pack([len(ids) // 4 for _, ids in docs], tiers)
            steps = step_groups(windows, step_ids)
            columns: list[list] = [[] for _ in schema]
            for k, (size, pieces) in enumerate(windows):
                offset = 0
                for doc, at, n in pieces:
                    doc_id, ids = docs[doc]
                    row = (
                        doc_id, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), len(ids) // 4,
                        base + sequences + k, offset, size, base + groups + steps[k],
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += n
            sequences += len(windows)
            groups += max(steps, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in _slices(batch):
                texts = table.ids(pc.fill_null(part.column(1), ""))
                for doc_id, own in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = own + end
                    docs.append((doc_id, ids))
                    held += len(ids) // 4
                    if held >= block_ids:
                        yield flush()
                        docs, held = [], 0
        if docs:
            yield flush()
            docs.clear()
        table.rest()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    block_ids: int = BLOCK_IDS,
    step_ids: int = STEP_IDS,
) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence.

    ``tokenizer_path`` names a file that every executor can open. ``start`` counts the
    document's ids before the piece, ``offset`` the sequence's ids before it; ``tier``
    is the sequence's size and ``step_group`` the group it is trained in.
    """
    if any(a <= b for a, b in zip(tiers, tiers[1:], strict=False)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be falling powers of two")
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(_packed(tokenizer_path, tiers, block_ids, step_ids), _SCHEMA)
