"""SentencePiece BPE encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; each normalised character remembers the source
byte at which its prefix starts. Normalised text is cut wherever no piece of the vocabulary holds the two neighbouring characters side by
side: no merge can cross such a place, so each distinct segment is merged once and remembered. Ids and the segments' character counts are
then laid out with numpy, and every piece's end is looked up among the source offsets: pieces come with the bytes of the original text
that they stand for. A character without a piece becomes one piece a byte; the last one holds the character's bytes, as in the library.

Nulls and empty texts have no ids. Repeated rows each get their row, null ids stay null, other columns are not looked at, an empty table
gives an empty result. Very long texts are taken whole: a segment of n characters costs n log n. Models must be BPE with byte fallback and
have no pieces of the user's or unused ones; others are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, text_of

SPACE = "▁"
#: Segments whose ids a worker keeps; beyond it the cache starts anew.
CACHE_SEGMENTS = 400_000
#: Segments up to so many characters are merged by going over all neighbours each time, longer ones with a heap.
SHORT = 40
INFINITE = float("inf")
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("byte_by_byte", lambda e: ("�", e.start + 1))


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled map: a double-array trie of UTF-8 keys, whose values are places in the text behind it."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, told = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    jump = (units >> 10) << ((units & 512) >> 6)
    at, keys, rules = np.zeros(1, np.int64), [b""], {}
    letters = np.arange(1, 256)
    while len(at):
        to = at[:, None] ^ jump[at][:, None] ^ letters
        inside = to < len(units)
        node, letter = np.nonzero(inside & ((units[np.where(inside, to, 0)] & 0x800000FF) == letters))
        at, keys = to[node, letter], [keys[n] + bytes([c + 1]) for n, c in zip(node.tolist(), letter.tolist(), strict=True)]
        for k in np.flatnonzero((units[at] >> 8) & 1).tolist():
            start = int(units[at[k] ^ jump[at[k]]] & 0x7FFFFFFF)
            rules[keys[k].decode(errors="surrogateescape")] = told[start : told.index(b"\0", start)].decode()
    return rules


def widths(cps: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != m.trainer_spec.BPE or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models with byte fallback, white space as prefix and no pieces of the user's are known")
        self.rules = character_map(m.normalizer_spec.precompiled_charsmap)
        self.starts = re.compile("[" + "".join(sorted({re.escape(k[0]) for k in self.rules})) + "]") if self.rules else None
        self.longest = max(map(len, self.rules), default=0)
        self.prefix, self.trim = m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces
        self.piece = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.scores = {p.piece: -p.score for p in m.pieces if p.type == NORMAL and len(p.piece) > 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        surface = m.trainer_spec.unk_surface.encode()
        self.bytes = [b"" if p.type == CONTROL else surface if p.type == UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.spaced = [p.type == NORMAL and p.piece.startswith(SPACE) for p in m.pieces]
        self.control = [p.type == CONTROL for p in m.pieces]
        self.controls = {i for i, hidden in enumerate(self.control) if hidden}
        several = [*self.scores]
        letters = sorted({c for p in several for c in p})
        number = {c: k + 1 for k, c in enumerate(letters)}  # 0: in no piece of several characters
        self.klass = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        self.klass[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in several:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[number[a], number[b]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.ids, self.extent = array("q", [0]), array("i"), array("i")  # of each segment: ids and the characters that they stand for

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the source byte at which it starts."""
        if not self.trim and (self.starts is None or not self.starts.search(text)):
            source = np.zeros(len(text) + 1, np.int64)
            np.cumsum(widths(code_points(text)), out=source[1:])
            out = text.replace(" ", SPACE)
            return (SPACE + out, np.concatenate([[0], source])) if self.prefix and text else (out, source)
        made: list[tuple[str, int]] = []  # what a prefix becomes, its bytes
        done = 0
        for m in self.starts.finditer(text) if self.starts else ():
            if m.start() < done:
                continue
            for n in range(min(self.longest, len(text) - m.start()), 0, -1):
                key = text[m.start() : m.start() + n]
                if key in self.rules:
                    made += [(c, len(c.encode())) for c in text[done : m.start()]]
                    made.append((self.rules[key], len(key.encode())))
                    done = m.start() + n
                    break
        made += [(c, len(c.encode())) for c in text[done:]]
        consumed, at = 0, 0
        while self.trim and at < len(made) and made[at][0] == " ":
            consumed += made[at][1]
            at += 1
        if at == len(made):
            return "", np.zeros(1, np.int64)
        out, source = ([SPACE], [consumed]) if self.prefix else ([], [])
        after_space = self.trim
        for told, size in made[at:]:
            told = told.lstrip(" ") if after_space else told
            if told:
                out += told
                source += [consumed] * len(told)
                after_space = self.trim and told.endswith(" ")
            consumed += size
        out = ["".join(out).replace(" ", SPACE)]
        while self.trim and out[0].endswith(SPACE):
            out[0] = out[0][:-1]
            consumed = source.pop()
        return out[0], np.array([*source, consumed], np.int64)

    def merged(self, segment: str) -> list[str]:
        """Pieces of a segment: always the neighbours that make the best piece, of equals the leftmost."""
        parts = list(segment)
        if len(parts) <= SHORT:
            found = self.scores
            scores = [found.get(a + b, INFINITE) for a, b in zip(parts, parts[1:], strict=False)]
            while scores and (best := min(scores)) < INFINITE:
                i = scores.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i:
                    scores[i - 1] = found.get(parts[i - 1] + parts[i], INFINITE)
                if i < len(scores):
                    scores[i] = found.get(parts[i] + parts[i + 1], INFINITE)
            return parts
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(two := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (score, a, b, two))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, two = heapq.heappop(heap)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != two or after[a] != b:
                continue
            parts[a], parts[b] = two, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p]

    def _learn(self, segment: str) -> int:
        for p in self.merged(segment):
            one = self.piece.get(p)
            if one is None:
                data = p.encode("utf-8", "surrogatepass")
                self.ids.extend(self.byte[b] for b in data)
                self.extent.extend([0] * (len(data) - 1) + [1])
            else:
                self.ids.append(one)
                self.extent.append(len(p))
        self.at.append(len(self.ids))
        self.known[segment] = k = len(self.known)
        return k

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids and the limits of their pieces in the text's bytes: piece k goes from limit k to limit k + 1."""
        if len(self.known) > CACHE_SEGMENTS:
            self._forget()
        parts = [self.normalised(t) for t in texts]
        norm = "".join(p for p, _ in parts)
        if not norm:
            return [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in texts]
        bounds = np.cumsum([0] + [len(p) for p, _ in parts])
        kind = self.klass[np.minimum(code_points(norm), len(self.klass) - 1)]
        cut = np.zeros(len(norm) + 1, bool)
        cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        segments = [norm[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for s in dict.fromkeys(segments):
            if s not in self.known:
                self._learn(s)
        codes = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        place = np.array(self.at, np.int64)
        count = place[codes + 1] - place[codes]
        upto = np.cumsum(count)
        where = np.repeat(place[codes] - (upto - count), count) + np.arange(int(upto[-1]))
        ids, reach = np.array(self.ids, np.int32)[where], np.cumsum(np.array(self.extent, np.int64)[where])
        limits = np.concatenate([[0], upto])[np.searchsorted(at, bounds)].tolist()
        out = []
        for k, (_, source) in enumerate(parts):
            a, b = limits[k], limits[k + 1]
            out.append((ids[a:b], source[np.concatenate([[0], reach[a:b] - bounds[k]])]))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that make no UTF-8 become U+FFFD one by one, the space before the first word goes."""
        table = self.bytes
        parts = [[*run] for hidden, run in groupby(ids, self.control.__getitem__) if not hidden] if not self.controls.isdisjoint(ids) else [ids]
        told = "".join([b"".join([table[i] for i in part]).decode("utf-8", "byte_by_byte") for part in parts])
        gone = 0
        if self.prefix or self.trim:
            for i in chain.from_iterable(parts):
                if not self.spaced[i]:
                    break
                gone += 1
                if not self.trim or len(table[i]) > 1:
                    break
        return told[gone:]


@lru_cache(2)
def of_file(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array of the parts."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), kind))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids, begins, ends (UTF-8 bytes of the text, end exclusive) of each row, and the text of the ids if it is asked for.

    No shuffle: each partition works alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = of_file(model)
        for batch in chunks(batches):
            found = own.encode(batch.column(1).to_pylist())
            columns = ragged([i for i, _ in found], pa.int32()), ragged([x[:-1] for _, x in found], pa.int32()), ragged([x[1:] for _, x in found], pa.int32())
            told = [pa.array([own.decode(i.tolist()) for i, _ in found], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *told], names)

    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if decoded else "")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids, ...) with their text in column `decoded`; null ids have no text, ids that are null or not of the model's are an error."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, decoded string"
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = of_file(model)
        for batch in batches:
            told = [None if ids is None else own.decode(ids) for ids in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(read(spark, sf_dir, "documents"), model, decoded=True)
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"))
