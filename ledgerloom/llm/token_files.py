"""Token ids in wavelet matrices, a compressed file for each shard (operator 12).

Documents are put in order of doc_id by a range exchange and a sort, tokenised as they stream by, and cut into shards of
about SHARD_TOKENS ids. A shard's ids are turned into bit planes, highest first; each plane is followed by the order in which
zeros of the plane before come first (Claude, Navarro and Ordóñez, 2015). A plane is stored in chunks, compressed where that
helps, with the number of ones before each, so that one file answers, reading a chunk for each plane: which id stands at a
place, how often an id occurs before a place, and where its k-th occurrence is. Reading all of it runs the planes backwards.

Files are written under a name of their own and renamed when whole; the manifest, a table of the files that the tasks which
counted have made, is what is read, so a lost or repeated task leaves at most a file that nothing names. Places that a
document has in all ids are sums over the manifest.
"""

from __future__ import annotations

import io
import json
import os
import re
import string
import struct
import uuid
import zlib
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import arrow_store
from .common import cut, own_names, own_path

#: Ids of a shard, about; a longer document is a shard alone. Units of text that a Python worker remembers.
SHARD_TOKENS, REMEMBERED = 1_000_000, 500_000
#: Bytes of text that are encoded at once, about: units that occur in all of it are looked up once.
TEXT_BYTES = 24_000_000
#: Characters that the library is given in one call, about.
CALL_CHARS = 500_000
#: Bits of a chunk of a plane.
CHUNK = 1 << 16
END = 0
MAGIC = b"WVLT1\n"
#: Before a space that follows no blank, GPT-2's pattern always ends a match, whatever follows; before a line break between two
#: others that are no blanks, or before either of two such, as well. Texts with other spaces and line breaks are not parted so (UNSURE).
UNSURE = r"^ |[\s\x0b\x1c-\x1f\x{85}\pZ] |[\t\x0b-\r\x1c-\x1f\x{85}\pZ]\n|\n\n\n|\n[\t\x0b-\r\x1c-\x1f\x{85}\pZ]|\n\n\z"
PARTS = re.compile(r"(?<=\S)(?= )")
#: Letters, all of them old, at the start of a stretch are a match of their own when another kind of character follows, such as one of TAIL.
LETTERS = r"^\n?[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{52F}\x{5D0}-\x{5EA}\x{620}-\x{64A}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]+$"
TAIL = string.punctuation + string.digits
#: Units that may follow each other in one text for the library: a space or line break and then no blank.
SPACED = r"^[ \n][^\s\x0b\x1c-\x1f\x{85}\pZ]+$"
_MANIFEST = "task int, path string, n_docs bigint, n_tokens bigint, size_bytes bigint, ahead bigint"


def tokenizer(path: str | None):
    """The tokenizer in a file of the tokenizers library; without a path, the byte-level BPE of 50,257 ids among the public ones."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    if hasattr(tok.model, "_resize_cache"):  # what is encoded here is new, so a cache of words only costs
        tok.model._resize_cache(0)
    return tok


def gpt2(tok) -> bool:
    """Whether a tokenizer parts texts by GPT-2's pattern alone, and no added token can lie over the places where Encoder parts them."""
    how = json.loads(tok.to_str())
    before = how["pre_tokenizer"] or {}
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    clear = all(t["content"] and not t["content"][0].isalpha() and t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in how["added_tokens"])
    return own and clear and how["model"]["type"] == "BPE" and not any(how[k] for k in ("normalizer", "truncation", "padding"))


def strings(texts: pa.Array) -> list[str]:
    """The values of an array without nulls, by way of numpy, which makes no Arrow scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def joined(*parts) -> pa.Array:
    """Arrays of texts or bytes joined row by row; a str stands in each row."""
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()) if any(isinstance(p, pa.LargeStringArray) for p in parts) else pa.scalar(b"", pa.large_binary()))


def lots(texts: list[str], chars: int):
    """texts in turn, in lists of about so many characters."""
    lot = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) // chars
    for begin, stop in pairwise([0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)]):
        if stop > begin:
            yield texts[begin:stop]


def ends_of(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What words have after cores, which they start with."""
    size, skip = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, cores))
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)] + skip
    left = size - skip
    to = np.r_[0, np.cumsum(left)]
    got = data[np.repeat(start - to[:-1], left) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(to), pa.py_buffer(got))


def encoder(path: str | None) -> "Encoder":
    """The encoder of this Python worker for the tokenizer at path. Workers outlive tasks, so what one has learned serves the next."""
    import tokenizers

    # A task has one core; threads of the library's own would only wait for each other.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = tokenizers.__dict__.setdefault("_held_encoders", {})
    if path not in held:
        held[path] = Encoder(tokenizer(path))
    return held[path]


class Encoder:
    """Ids of texts. Where the tokenizer parts texts by GPT-2's pattern, units (letters with the space before them, what follows
    them in a stretch) repeat, so each is encoded once and remembered; of too many, those that have been used again stay. Other
    tokenizers are given whole texts.
    """

    def __init__(self, tok, remembered: int = REMEMBERED):
        self.tok, self.limit, self.units = tok, remembered, gpt2(tok)
        self.of: dict[str, int] = {}
        self.ids, self.uses = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        # An added token ends the text before it, so two line breaks there are one match, as at the end.
        added = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
        self.unsure = UNSURE + "".join(rf"|\n\n{t}" for t in added)
        # Where units follow each other that start with a space or line break, these ids start them.
        self.first = np.zeros(max(tok.get_vocab().values(), default=0) + 1, bool)
        self.first[[i for t, i in tok.get_vocab().items() if t.startswith(("\u0120", "\u010a"))]] = True

    def _forget(self) -> None:
        """Keep half as many as may be remembered: those used most, of 256 characters at most."""
        stay = self.uses >= max(2, int(np.partition(self.uses, -(self.limit // 2))[-(self.limit // 2)]) + 1) if len(self.uses) > self.limit // 2 else self.uses > 1
        kept = [k for k, ok in zip(self.of, stay.tolist(), strict=True) if ok and len(k) <= 256]
        at = np.fromiter(map(self.of.__getitem__, kept), np.int64, len(kept))
        self.of = dict(zip(kept, range(len(kept)), strict=True))
        self.ids, self.uses = self.ids.take(pa.array(at)), self.uses[at] // 2

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made, sizes = [np.zeros(0, np.uint32)], []
        for lot in lots(texts, CALL_CHARS):
            got = [e.ids for e in self.tok.encode_batch_fast(lot, add_special_tokens=False)]
            made.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes += map(len, got)
        return np.concatenate(made), np.array(sizes, np.int64)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Encode units, SPACED ones many at a time, the others apart, and give their numbers."""
        spaced = pc.match_substring_regex(new, SPACED)
        line, others = strings(new.filter(spaced)), strings(new.filter(pc.invert(spaced)))
        number = len(self.of) + np.argsort(np.argsort(pc.invert(spaced).to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        made = []
        for call in lots(line, CALL_CHARS):
            many = list(lots(call, CALL_CHARS // 100))
            for lot, got in zip(many, self.tok.encode_batch_fast(["".join(x) for x in many], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.uint32)
                starts = np.flatnonzero(self.first[ids])
                one = len(starts) == len(lot) and starts[0] == 0
                made.append((ids, np.diff(starts, append=len(ids))) if one else self._apart(lot))
        made.append(self._apart(others))
        ids, ends = np.concatenate([x for x, _ in made]), np.r_[0, np.cumsum(np.concatenate([n for _, n in made]))].astype(np.int64)
        more = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])
        self.of.update(zip(chain(line, others), range(len(self.of), len(self.of) + len(new)), strict=True))
        self.ids, self.uses = pa.concat_arrays([self.ids, more]), np.r_[self.uses, np.zeros(len(new), np.int64)]
        return number

    def _known(self, units: pa.Array) -> pa.Array:
        """The ids of units as bytes, those that are new learned first."""
        held = units.dictionary_encode()
        keys = strings(held.dictionary)
        found = np.fromiter(map(self.of.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(held.dictionary.take(pa.array(new)))
        self.uses[found] += 1
        return self.ids.take(pa.array(found[held.indices.to_numpy()]))

    def _stretches(self, words: pa.Array, lead: str = "") -> pa.Array:
        """The ids, as bytes, of stretches after a space (lead), or after nothing where they start with a line break."""
        cores = pc.ascii_rtrim(words, TAIL)
        cores = pc.if_else(pc.match_substring_regex(cores, LETTERS), cores, words)
        ends = ends_of(words, cores)
        if lead:
            cores = pc.if_else(pc.starts_with(cores, "\n"), cores, joined(lead, cores))
        return joined(self._known(cores), self._known(ends))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, how many each has)."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not self.units:
            return self._apart(strings(texts))
        if len(self.of) > self.limit or self.ids.nbytes > 64 * self.limit:
            self._forget()
        unsure = pc.match_substring_regex(texts, self.unsure)
        # Other texts are parted at every space and line break; of equal stretches in the lot one is looked up.
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(unsure)), "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy()
        at = lists.values.dictionary_encode()
        place, heads = at.indices.to_numpy().astype(np.int32), offsets[:-1]
        first = lists.values.take(pa.array(heads))
        place[heads] = len(at.dictionary)
        after = np.flatnonzero(np.bincount(place, minlength=len(at.dictionary) + 1)[:-1])
        number = np.zeros(len(at.dictionary) + 1, np.int32)
        number[after] = np.arange(len(after))
        place = number[place]
        place[heads] = len(after) + np.arange(len(heads))
        held, pieces = [self._stretches(at.dictionary.take(pa.array(after)), " "), self._stretches(first)], np.diff(offsets)
        odd = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        if len(odd):
            parts = [PARTS.split(t) for t in strings(texts.take(pa.array(odd)))]
            more = np.array([len(p) for p in parts], np.int64)
            doc = np.concatenate([np.repeat(np.setdiff1d(np.arange(len(texts)), odd), pieces), np.repeat(odd, more)])
            place = np.concatenate([place, len(after) + len(heads) + np.arange(int(more.sum()), dtype=np.int32)])[np.argsort(doc, kind="stable")]
            held.append(self._known(pa.array(list(chain.from_iterable(parts)), pa.large_string())))
            pieces = np.bincount(doc, minlength=len(texts))
        got = pa.concat_arrays(held).take(pa.array(place))
        if not len(got):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        offsets = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] // 4
        ids = np.frombuffer(got.buffers()[2], np.uint32, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint32)
        return ids, np.diff(offsets[np.cumsum(pieces)], prepend=0)


def packed(ids: np.ndarray, docs: list, sizes: np.ndarray) -> bytes:
    """The file of a shard: a header (JSON), the documents' ids and sizes, and the planes."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes, body = [], io.BytesIO()
    codec = pa.Codec("zstd", 1)

    def put(data: bytes) -> list[int]:
        small = codec.compress(data, asbytes=True)
        kept = small if len(small) < len(data) else data
        at = body.tell()
        body.write(kept)
        return [at, len(kept), len(data)]

    for bit in reversed(range(width)):
        one = (ids & ids.dtype.type(1 << bit)) != 0
        bits = np.packbits(one, bitorder="little").tobytes()
        chunks = [put(bits[i : i + CHUNK // 8]) for i in range(0, len(bits), CHUNK // 8)]
        ones = np.cumsum([0, *(np.count_nonzero(one[i : i + CHUNK]) for i in range(0, len(one), CHUNK))]).tolist()
        planes.append({"chunks": chunks, "ones": ones})
        if bit:
            # A chunk at a time, as its places stay in the processor's cache.
            after, zeros, begin = np.empty_like(ids), 0, len(ids) - ones[-1]
            for i, before in zip(range(0, len(ids), CHUNK), ones, strict=False):
                here, part = one[i : i + CHUNK], ids[i : i + CHUNK]
                for to, at in ((zeros, np.flatnonzero(~here)), (begin + before, np.flatnonzero(here))):
                    part.take(at, out=after[to : to + len(at)], mode="clip")
                zeros = i + CHUNK - ones[i // CHUNK + 1]
            ids = after
    null = [d is None for d in docs]
    head = {"n": int(sizes.sum()), "width": width, "planes": planes, "docs": put(np.array([0 if d is None else d for d in docs], "<i8").tobytes()), "null": put(np.packbits(null).tobytes()), "sizes": put(sizes.astype("<i8").tobytes()), "n_docs": len(docs)}
    text = zlib.compress(json.dumps(head).encode())
    return MAGIC + struct.pack("<q", len(text)) + text + body.getvalue()


class TokenFile:
    """A shard's file: read(at, size) gives bytes of it. Chunks are read as they are asked for and kept."""

    def __init__(self, read):
        start = read(0, len(MAGIC) + 8)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("no file of token ids")
        size = struct.unpack("<q", start[len(MAGIC) :])[0]
        self.head = json.loads(zlib.decompress(read(len(start), size)))
        self._read, self._base = read, len(start) + size
        self.n, self.width, self._planes = self.head["n"], self.head["width"], self.head["planes"]
        self.zeros = [self.n - p["ones"][-1] for p in self._planes]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, at: int, kept: int, size: int) -> bytes:
        data = self._read(self._base + at, kept)
        return data if kept == size else pa.Codec("zstd").decompress(data, size, asbytes=True)

    def _chunk(self, plane: int, i: int) -> np.ndarray:
        if (plane, i) not in self._held:
            self._held[plane, i] = np.frombuffer(self._part(*self._planes[plane]["chunks"][i]), np.uint8)
        return self._held[plane, i]

    def docs(self) -> tuple[list, np.ndarray]:
        """(ids of the documents, how many token ids each has)."""
        ids = np.frombuffer(self._part(*self.head["docs"]), "<i8").tolist()
        null = np.unpackbits(np.frombuffer(self._part(*self.head["null"]), np.uint8))[: len(ids)]
        return [None if x else i for i, x in zip(ids, null.tolist(), strict=True)], np.frombuffer(self._part(*self.head["sizes"]), "<i8")

    def bit(self, plane: int, i: int) -> int:
        return int(self._chunk(plane, i // CHUNK)[i % CHUNK >> 3] >> (i & 7) & 1)

    def rank(self, plane: int, i: int) -> int:
        """Ones before place i."""
        if i % CHUNK == 0:
            return self._planes[plane]["ones"][i // CHUNK]
        data, bits = self._chunk(plane, i // CHUNK), i % CHUNK
        whole = int(np.bitwise_count(data[: bits >> 3]).sum())
        return self._planes[plane]["ones"][i // CHUNK] + whole + (int(data[bits >> 3]) & ((1 << (bits & 7)) - 1)).bit_count() if bits & 7 else self._planes[plane]["ones"][i // CHUNK] + whole

    def select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of the kind."""
        ones = self._planes[plane]["ones"]
        before = lambda c: ones[c] if bit else min(c * CHUNK, self.n) - ones[c]
        low, high = 0, len(ones) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        size = min(CHUNK, self.n - low * CHUNK)
        bits = np.unpackbits(self._chunk(plane, low), bitorder="little")[:size]
        return low * CHUNK + int(np.flatnonzero(bits == bit)[k - before(low)])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.width):
            b = self.bit(p, i)
            out = out << 1 | b
            i = self.zeros[p] + self.rank(p, i) if b else i - self.rank(p, i)
        return out

    def _interval(self, token: int, stop: int) -> tuple[int, int]:
        """Where the ids before place stop that are token lie below the last plane."""
        low, high = 0, stop
        for p in range(self.width):
            a, z = self.rank(p, low), self.rank(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + z) if token >> (self.width - 1 - p) & 1 else (low - a, high - z)
        return low, high

    def count(self, token: int, stop: int | None = None) -> int:
        """How often token occurs before place stop, or at all."""
        if not 0 <= token < 1 << self.width:
            return 0
        low, high = self._interval(token, self.n if stop is None else max(0, min(stop, self.n)))
        return high - low

    def locate(self, token: int, k: int) -> int | None:
        """The place of the k-th (from 0) occurrence of token, None if there are no more."""
        if not 0 <= k < self.count(token):
            return None
        at = self._interval(token, 0)[0] + k
        for p in reversed(range(self.width)):
            bit = token >> (self.width - 1 - p) & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order, from the lowest plane up: the zeros of a plane are the first of the next one's order, the ones the rest."""
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for p in reversed(range(self.width)):
            above, zeros, ones = np.empty_like(out), 0, self.zeros[p]
            for i in range(len(self._planes[p]["chunks"])):
                part = above[i * CHUNK : (i + 1) * CHUNK]
                one = np.unpackbits(self._chunk(p, i), count=len(part), bitorder="little").view(bool)
                at = np.flatnonzero(~one)
                part[at] = out[zeros : zeros + len(at)]
                zeros += len(at)
                at = np.flatnonzero(one)
                part[at] = out[ones : ones + len(at)] | out.dtype.type(1 << (self.width - 1 - p))
                ones += len(at)
                self._held.pop((p, i))
            out = above
        return out


def opened(uri: str) -> TokenFile:
    """A file of the manifest."""
    store, path = arrow_store(uri)
    f = store.open_input_file(path)
    return TokenFile(lambda at, size: f.read_at(size, at))


def write(docs: DataFrame, directory: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS, end: int | None = END) -> DataFrame:
    """Write the ids of docs under directory and return the manifest: path, n_docs, n_tokens, size_bytes, start (ids of all files before it).

    Each whole text is encoded without special tokens, a null one as if empty, and followed by end, unless that is null.
    Files hold documents in ascending order of doc_id, nulls last; rows that share one come by hash of their text. path names
    the tokenizer's file.
    """
    own_names(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Equal rows may fall on either side of a cut, so no key is too large for one task.
    keyed = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), "_h", "_n"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        coder, store, task, ahead = encoder(path), arrow_store(directory), TaskContext.get().partitionId(), 0
        ids, parts, sizes, total = [], [], [], 0

        def close():
            nonlocal ids, parts, sizes, total, ahead
            data = packed(np.concatenate(parts), ids, np.concatenate(sizes))
            name = f"{task:06d}-{ahead:012d}-{uuid.uuid4().hex}"
            store[0].create_dir(store[1], recursive=True)
            with store[0].open_output_stream(f"{store[1]}/{name}.part") as f:
                f.write(data)
            store[0].move(f"{store[1]}/{name}.part", f"{store[1]}/{name}.wavelet")
            row = task, f"{directory.rstrip('/')}/{name}.wavelet", len(ids), total, len(data), ahead
            kinds = pa.int32(), pa.string(), *[pa.int64()] * 4
            ids, parts, sizes, total, ahead = [], [], [], 0, ahead + total
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["task", "path", "n_docs", "n_tokens", "size_bytes", "ahead"])

        for batch in batches:
            ends, row = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while row < batch.num_rows:
                stop = max(row + 1, min(int(np.searchsorted(ends, (ends[row - 1] if row else 0) + TEXT_BYTES)), row + 20_000))
                part = batch.slice(row, stop - row)
                got, each = coder.encode(part.column(1))
                if end is not None:
                    got, each = np.insert(got, np.cumsum(each), end), each + 1
                docs, to, at, row = part.column(0).to_pylist(), np.cumsum(each), 0, stop
                while at < len(docs):
                    # As many documents as the shard still takes, with the one that fills it.
                    before = int(to[at - 1]) if at else 0
                    upto = min(len(docs), int(np.searchsorted(to, before + shard_tokens - total)) + 1)
                    ids += docs[at:upto]
                    parts.append(got[before : to[upto - 1]].astype(np.uint32))
                    sizes.append(each[at:upto])
                    total += int(to[upto - 1]) - before
                    at = upto
                    if total >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    made = cut(placed.mapInArrow(run, _MANIFEST))
    # A row for each task of the exchange; the files stay with the tasks that wrote them, so reading is as spread as writing.
    tasks = made.groupBy("task").agg(F.sum("n_tokens").alias("_all"))
    before = tasks.select("task", (F.sum("_all").over(Window.orderBy("task")) - F.col("_all")).alias("_before"))
    return made.join(F.broadcast(before), "task").select("path", "n_docs", "n_tokens", "size_bytes", (F.col("_before") + F.col("ahead")).alias("start"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array<int>) of every document in the files of a manifest."""

    def run(batches):
        for path, begin in _files(batches):
            f = opened(path)
            ids, (docs, sizes) = f.all().astype(np.int32), f.docs()
            first = np.cumsum(sizes) - sizes
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(first + begin), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))], names=["doc_id", "start", "n_tokens", "ids"])

    return manifest.select("path", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def checksums(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) of every document in the files of a manifest."""

    def run(batches):
        for path, begin in _files(batches):
            f = opened(path)
            data, (docs, sizes) = f.all().astype("<u4"), f.docs()
            ends = np.cumsum(sizes).tolist()
            crc = [zlib.crc32(data[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(np.array(ends) - sizes + begin), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _files(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def op12_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return checksums(write(docs, own_path(spark, "tokens")))


QUERIES = {"op12_token_files": op12_token_files}
SQL = {}
