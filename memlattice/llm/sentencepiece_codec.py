"""SentencePiece unigram encoding and decoding.

Pieces live in a double-array trie. A text gets the whitespace marker in front and for each space, and is cut where no
piece can reach across: before a marker that follows another character, and around characters that only occur as pieces
of their own. Between cuts the best segmentation is found by Viterbi over the log scores; of equal paths the one with the
earlier-starting last piece wins. A character without a piece costs the least score less ten and becomes its bytes' pieces
(or the unknown piece where the vocabulary has none). Arrow cuts the words and finds the distinct ones; those not
remembered in a bounded two-generation cache run through the trie and the Viterbi recursion together in numpy.

A unigram vocabulary brings its log scores. Those of any other kind, such as byte-pair merges, have ranks in that place:
`fitted` then takes each piece's share in the vocabulary's own encoding of all texts, none left out, as its likelihood.

A null text gives null ids, an empty one none; of an empty table the result is empty. Decoding turns the marker back into spaces, so encode-decode returns every
text that doesn't hold the marker itself (U+2581). The vocabulary is read on the driver from a path that is a parameter,
and broadcast: its size is the vocabulary's, whatever the input. Repeated rows are encoded alike; clashing column names
don't matter, the output columns take free names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, sliced, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer stretches go through the recursion one by one.
LONG = 64
#: Model type of a unigram vocabulary in a model file.
UNIGRAM = 1
#: Distinct stretches a task holds at most while it counts pieces.
COUNTED = 200_000
#: Bytes of text that are worked on together; a longer text goes alone.
PORTION = 2 << 20


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: from state s, byte c leads to base[s] + c if check there is s; value is -1 where no key ends."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, values = [keys[i] for i in order], [values[i] for i in order]
    base, check, value, used = [1], [-1], [-1], bytearray(b"\1")
    first = 257  # no byte is larger, so that every free slot from here on can serve any of them

    def grow(n: int) -> None:
        if n > len(used):
            more = max(n - len(used), 4096)
            used.extend(bytes(more))
            base.extend([1] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[state] = values[lo]
            lo += 1
        kids, at = [], lo
        while at < hi:
            c, end = keys[at][depth], at
            while end < hi and keys[end][depth] == c:
                end += 1
            kids.append((c, at, end))
            at = end
        if not kids:
            continue
        grow(first + 1)
        while first < len(used) and used[first]:
            first += 1
        slot = first if len(kids) < 8 else max(first, len(used) - 4096)
        while True:
            grow(slot + 257)
            b = slot - kids[0][0]
            if b > 0 and not any(used[b + c] for c, _, _ in kids):
                break
            slot += 1
        base[state] = b
        for c, at, end in kids:
            used[b + c], check[b + c] = 1, state
            todo.append((b + c, at, end, depth + 1))
    grow(len(used) + 512)
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [starts, starts + lengths) of flat that `at` names, one after the other, and each one's length."""
    n = lengths[at]
    return flat[np.arange(int(n.sum())) + np.repeat(starts[at] - (np.cumsum(n) - n), n)], n


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and each one's length (0 for null)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends).astype(np.int64)


def units(texts: pa.Array, stretch: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """The order in which the texts were taken, the distinct units, the unit at each place, and how many places each text has.

    A unit is a word with its marker, cut out by Arrow, for texts that have single spaces between words and nowhere else;
    of other texts it is a stretch of the pattern. No piece reaches from one unit into the next.
    """
    texts = pc.fill_null(texts, "")
    tests = [pc.equal(texts, ""), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARKER)]
    odd = reduce(pc.or_, tests)
    words = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    coded = words.flatten().dictionary_encode()
    some = [MARKER + w for w in coded.dictionary.to_pylist()]
    code: dict[str, int] = {}
    find = re.compile(stretch, re.DOTALL).findall
    cut = [find(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts.filter(odd).to_pylist()]
    places = [code.setdefault(x, len(code)) for xs in cut for x in xs]
    at = np.concatenate((coded.indices.to_numpy().astype(np.int64), np.array(places, np.int64) + len(some)))
    sizes = np.concatenate((pc.list_value_length(words).to_numpy(), np.fromiter(map(len, cut), np.int64, len(cut)))).astype(np.int64)
    mask = np.asarray(odd)
    return np.concatenate((np.nonzero(~mask)[0], np.nonzero(mask)[0])), some + list(code), at, sizes


@dataclass
class Codec:
    """Everything encode() and decode() need; plain arrays and lists, so it can be broadcast."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int]
    unknown: int
    special: frozenset
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown_score: float
    stretch: str
    young: dict = field(default_factory=dict)
    old: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        return cls.of([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], m.unk_id(), {i for i in ids if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}, {i for i in ids if m.is_byte(i)})

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], unknown: int, special: set[int], byte_pieces: set[int]) -> Codec:
        """byte_pieces: the ids of <0x00> to <0xFF>, all or none of them."""
        plain = [i for i in range(len(pieces)) if i not in special and i not in byte_pieces and pieces[i]]
        if bad := [pieces[i] for i in plain if MARKER in pieces[i].lstrip(MARKER)]:
            raise ValueError(f"pieces with the marker after other characters: {bad[:3]}")
        by_value = {int(pieces[i][1:-1], 16): i for i in byte_pieces}
        joined = {c for i in plain if len(pieces[i]) > 1 for c in pieces[i]} - {MARKER}
        inside = "".join(re.escape(c) for c in sorted(joined))
        stretch = (f"{MARKER}*[{inside}]+|" if joined else "") + f"{MARKER}+|."
        base, check, value = double_array([pieces[i].encode() for i in plain], plain)
        least = min((scores[i] for i in plain), default=0.0)
        return cls(pieces, np.array(scores, np.float64), [by_value[b] for b in range(256)] if len(by_value) == 256 else [], unknown, frozenset(special), base, check, value, least - UNKNOWN_PENALTY, stretch)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"} | {"young": {}, "old": {}}

    def _fallback(self, char: bytes) -> list[int]:
        return [self.byte_ids[b] for b in char] if self.byte_ids else [self.unknown]

    def _single(self, raw: bytes) -> list[int]:
        """Viterbi over one stretch, position by position."""
        if not hasattr(self, "_lists"):
            self._lists = self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n, low = len(raw), float("-inf")
        best, back = [low] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == low or raw[s] & 0xC0 == 0x80:
                continue
            one = s + 1
            while one < n and raw[one] & 0xC0 == 0x80:
                one += 1
            state, e, found = 0, s, False
            while e < n and check[t := base[state] + raw[e]] == state:
                state, e = t, e + 1
                if (v := value[t]) >= 0:
                    found |= e == one
                    if (x := best[s] + scores[v]) > best[e]:
                        best[e], back[e] = x, (s, v)
            if not found and (x := best[s] + self.unknown_score) > best[one]:
                best[one], back[one] = x, (s, -1)
        out, e = [], n
        while e:
            s, v = back[e]
            out.append([v] if v >= 0 else self._fallback(raw[s:e]))
            e = s
        return [i for part in reversed(out) for i in part]

    def _many(self, raws: list[bytes]) -> list[bytes]:
        """Viterbi over many stretches of at most 255 bytes at once: first every match of every position, then the recursion by
        place in the stretch. Each stretch has a slot for each of its bytes and one for its end. The ids (int32) of each as bytes."""
        lengths = np.fromiter(map(len, raws), np.int32, len(raws))
        text = np.frombuffer(b"".join(raws) + b"\0", np.uint8)
        ends = np.cumsum(lengths, dtype=np.int32)
        n, owner = int(ends[-1]), np.repeat(np.arange(len(raws), dtype=np.int32), lengths)
        at = np.nonzero((text[:n] & 0xC0) != 0x80)[0].astype(np.int32)
        width = np.diff(at, append=np.int32(n))  # a stretch's last character ends where the next stretch begins
        stop, slot = ends[owner[at]], at + owner[at]
        rel = (at - (ends - lengths)[owner[at]]).astype(np.uint8)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state, who, single = np.zeros(len(at), np.int32), np.arange(len(at), dtype=np.int32), np.zeros(len(at), bool)
        pos, depth = at, 0
        while len(who):
            nxt = self.base[state] + text[pos]
            ok = np.nonzero(self.check[nxt] == state)[0]
            state, who, pos = nxt[ok], who[ok], pos[ok] + np.int32(1)
            depth += 1
            v = self.value[state]
            hit = np.nonzero(v >= 0)[0]
            if len(hit):
                w = who[hit]
                found.append((w, v[hit], np.full(len(w), depth, np.int32)))
                single[w[width[w] == depth]] = True
            ok = np.nonzero(pos < stop[who])[0]
            state, who, pos = state[ok], who[ok], pos[ok]
        missing = np.nonzero(~single)[0].astype(np.int32)
        found.append((missing, np.full(len(missing), -1, np.int32), width[missing]))
        who, ids, size = (np.concatenate(x) for x in zip(*found))
        place = rel[who]
        order = np.argsort(place, kind="stable")
        who, ids, size = who[order], ids[order], size[order]
        begin = slot[who]
        score, end = np.where(ids >= 0, self.scores[ids], self.unknown_score), begin + size
        best = np.full(n + len(raws), -np.inf)
        first = ends - lengths + np.arange(len(raws), dtype=np.int32)
        best[first] = 0.0
        back = np.zeros(n + len(raws), np.int32)  # the match that leads to a slot
        cuts = np.concatenate(([0], np.cumsum(np.bincount(place))))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # matches of one place end at different slots of a stretch
            e = end[lo:hi]
            x = best[begin[lo:hi]] + score[lo:hi]
            better = np.nonzero(x > best[e])[0]
            best[e[better]], back[e[better]] = x[better], better + lo
        # walk back from every end at once, then put each stretch's pieces in order
        w, e, walked, count = np.arange(len(raws), dtype=np.int32), first + lengths, [], np.zeros(len(raws), np.int32)
        while len(w):
            m = back[e]
            walked.append((w, ids[m]))
            count[w] += 1
            e = begin[m]
            on = np.nonzero(e != first[w])[0]
            w, e = w[on], e[on]
        stops = np.cumsum(count)
        flat = np.empty(int(stops[-1]), np.int32)
        for step, (w, v) in enumerate(walked):
            flat[stops[w] - 1 - step] = v
        raw, at4 = flat.tobytes(), (4 * stops).tolist()
        out = [raw[i:j] for i, j in zip([0, *at4], at4)]
        for k in np.unique(np.searchsorted(stops, np.nonzero(flat < 0)[0], "right")).tolist():  # characters without a piece
            out[k] = np.array(self._single(raws[k]), np.int32).tobytes()
        return out

    def _resolved(self, some: list[str], cache: int) -> list[bytes]:
        """The ids (int32) of each unit as bytes; those not remembered are cut and go through the recursion together."""
        young, old = self.young, self.old
        out = list(map(young.get, some))
        gaps = [k for k, x in enumerate(out) if x is None]
        for k in gaps:
            if (x := old.get(some[k])) is not None:
                young[some[k]] = out[k] = x
        gaps = [k for k in gaps if out[k] is None]
        new = [some[k] for k in gaps]
        cut = list(map(re.compile(self.stretch, re.DOTALL).findall, new))
        need = list(set().union(*cut))
        short = [x for x in need if len(x) < LONG]
        ids = {x: np.array(self._single(x.encode()), np.int32).tobytes() for x in need if len(x) >= LONG}
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            ids.update(zip(part, self._many([x.encode() for x in part])))
        for k, u, x in zip(gaps, new, cut):
            young[u] = out[k] = ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x))
        if len(young) > cache:
            self.old, self.young = young, {}
        return out

    def encode_array(self, texts: pa.Array, cache: int = 300_000) -> pa.ListArray:
        """Ids (int32) of each text, none of a null one."""
        order, some, at, sizes = units(texts, self.stretch)
        raws = self._resolved(some, cache)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        flat = np.frombuffer(b"".join(raws), np.int32)
        ids, n = spread(flat, np.cumsum(lengths) - lengths, lengths, at)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
        return lists.take(pa.array(np.argsort(order)))

    def encode_batch(self, texts: list[str], cache: int = 300_000) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        lists = self.encode_array(pa.array(texts, pa.string()), cache)
        return [np.array(x, np.int32) for x in lists.to_pylist()]

    def _piece_bytes(self) -> list[bytes]:
        if not hasattr(self, "_bytes"):
            b = [b"" if i in self.special else p.replace(MARKER, " ").encode() for i, p in enumerate(self.pieces)]
            for value, i in enumerate(self.byte_ids):
                b[i] = bytes([value])
            b[self.unknown] = " ⁇ ".encode()
            self._bytes = b
            self._lengths = np.fromiter(map(len, b), np.int64, len(b))
            self._joined = np.frombuffer(b"".join(b), np.uint8)
        return self._bytes

    def decode(self, ids) -> str:
        """The text of the ids; special pieces give nothing, the unknown one " ⁇ "."""
        raw = b"".join(map(self._piece_bytes().__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")

    def decodes_to(self, lists: pa.ListArray, texts: pa.Array) -> np.ndarray:
        """Whether each list of ids decodes to its text, byte for byte and for all of them at once; a null text counts as one that does."""
        self._piece_bytes()
        starts = np.cumsum(self._lengths) - self._lengths
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        raw, n = spread(self._joined, starts, self._lengths, ids)
        cuts = np.concatenate(([0], np.cumsum(n)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        first, size = cuts[:-1], np.diff(cuts)
        bare = np.zeros(len(size), bool)
        bare[size > 0] = raw[first[size > 0]] == 32  # the marker in front of the text
        data, wanted = _bytes_of(texts)
        ok = size - bare == wanted
        keep = np.repeat(ok, size)
        keep[first[ok & bare]] = False
        wrong = np.concatenate(([0], np.cumsum(raw[keep] != data[np.repeat(ok, wanted)])))
        ends = np.cumsum(wanted[ok])
        ok[ok] = wrong[ends] == wrong[ends - wanted[ok]]
        return ok | np.asarray(texts.is_null())


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return n, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def model_type(proto: bytes) -> int:
    """1 unigram, 2 byte-pair merges, 3 words, 4 characters: field 3 of the trainer's settings, field 2; unigram if not set."""
    return next((v for k, part in _fields(proto) if k == 2 for n, v in _fields(part) if n == 3), UNIGRAM)


def own_ids(model, stretches: list[str]) -> list[list[int]]:
    """The vocabulary's own encoding of stretches. The library puts a marker in front of a text: a line end keeps it apart
    from the stretch's own, and both are dropped."""
    skip = len(model.encode("\n"))
    return [i[skip:] for i in model.encode(["\n" + x.replace(MARKER, " ") for x in stretches], num_threads=1)]


def fitted(df: DataFrame, text: str = "text", path: str = MODEL) -> Codec:
    """The codec of a vocabulary with unigram log scores: the file's, or for another kind of vocabulary the logs of the pieces'
    shares in its own encoding of all texts of df (half a count is added to each). df is read once; one row per piece is collected."""
    codec = Codec.load(path)
    with open(path, "rb") as f:
        proto = f.read()
    if model_type(proto) == UNIGRAM:
        return codec
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((codec.stretch, len(codec.pieces), proto))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        stretch, size, raw = shared.value
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        total, held = np.zeros(size), {}

        def add() -> None:
            words = list(held)
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                ids = own_ids(model, some)
                times = np.repeat(np.fromiter(map(held.__getitem__, some), np.int64, len(some)), np.fromiter(map(len, ids), np.int64, len(ids)))
                total[:] += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, len(times)), times, size)
            held.clear()

        for batch in sliced(batches, "text", PORTION):
            _, some, at, _ = units(batch.column(0), stretch)
            for u, n in zip(some, np.bincount(at, minlength=len(some)).tolist()):
                held[u] = held.get(u, 0) + n
            if len(held) > COUNTED:
                add()
        add()
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids].astype(np.int64))], ["piece", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(counted, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.full(len(codec.pieces), 0.5)
    for r in rows:
        n[r["piece"]] += r["n"]
    scores = np.log(n / n.sum())
    plain = codec.value[codec.value >= 0]
    return replace(codec, scores=scores, unknown_score=float(scores[plain].min(initial=0.0)) - UNKNOWN_PENALTY, young={}, old={})


def encoder(spark: SparkSession, path: str = MODEL, codec: Codec | None = None):
    """A column function: text -> struct(ids array<int>, exact boolean); exact: the ids decode to the text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(codec or Codec.load(path))

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]))
    def encode(texts: pa.Array) -> pa.Array:
        c, lists, exact = shared.value, [], []
        step = max(1, len(texts) * PORTION // max(texts.nbytes, 1))
        for at in range(0, len(texts), step):
            some = texts.slice(at, step)
            got = c.encode_array(some)
            lists.append(got)
            exact.append(c.decodes_to(got, some))
        ids = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        ids = pc.if_else(texts.is_null(), pa.scalar(None, ids.type), ids)
        return pa.StructArray.from_arrays([ids, pa.array(np.concatenate([*exact, np.zeros(0, bool)]))], ["ids", "exact"])

    return encode


def decoder(spark: SparkSession, path: str = MODEL, codec: Codec | None = None):
    """A column function: ids array<int> -> text; null for null."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(codec or Codec.load(path))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared.value.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def encode(df: DataFrame, text: str = "text", path: str = MODEL, codec: Codec | None = None) -> DataFrame:
    """df with ids, n_tokens and round_trip. Without a codec, the vocabulary's log scores are fitted to the texts if it has none."""
    codec = codec or fitted(df, text, path)
    got, ids, n, exact = free(df, "sp_got", "ids", "n_tokens", "round_trip")
    x = df.withColumn(got, encoder(df.sparkSession, path, codec)(F.col(text)))
    return x.withColumn(ids, F.col(got)["ids"]).withColumn(n, F.coalesce(F.size(ids), F.lit(0))).withColumn(exact, F.col(got)["exact"]).drop(got)


def op5(df: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text, for every document."""
    x = encode(df.select("doc_id", "text"), path=path)
    return x.select("doc_id", "ids", F.when(F.col("ids").isNull(), 0).otherwise(F.col("n_tokens")).alias("n_tokens"), "round_trip")


def stage(df: DataFrame, path: str = MODEL) -> DataFrame:
    """The documents with their ids."""
    return encode(df, path=path)
