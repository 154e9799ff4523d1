"""Operator 9: best-fit packing of tokenised documents under several capacities (vector best-fit)."""

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bounded_batches, load, materialize, tidied

MAX_TOKENS = 2048
BLOCK = 8192  # pieces that one task packs together
#: Outside this range (and for a few letters within) a text goes to the tokenizer whole, see Encoder.
_EXOTIC = re.compile("[^\\t-\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u02af\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
_CACHE = 50_000  # words; their cache holds twice as many at most
TOGETHER = 4_000_000  # characters of texts whose words are looked up together
_READY: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Text -> token ids as little-endian unsigned 32-bit bytes, exactly as the tokenizer gives them.

    The vocabulary's pre-tokenizer never joins across white space and its normaliser lower-cases, so the ids of a text
    are those of its lower-cased chunks in order, and those of a chunk are those of its words. The different chunks of
    many texts are taken apart once each, and so are their different words looked up. Words that occur again are kept, in a
    bounded cache; the tokenizer's merges run for the others together. Texts with characters for which
    letter case, classes or white space could differ between libraries go to the tokenizer as they are, and so do texts
    that hold the string of an added token: as the file has it, such a string is that token. With `special_as_text` it
    is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        plain = sorted({c.lower() for c in map(chr, range(0x21, 0x2100)) if not _EXOTIC.match(c)})  # two of them lie beyond
        letter, number = (re.escape("".join(c for c in plain if unicodedata.category(c)[0] == k)) for k in "LN")
        self.split = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        other = [b for b in range(256) if b not in (*range(33, 127), *range(161, 173), *range(174, 256))]
        self.letters = np.arange(256, dtype="<u2")  # the character that stands for each byte
        self.letters[other] = np.arange(256, 256 + len(other))
        self.letters[32] = 32  # stands between words
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.tok.get_vocab(), self.tok.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"\n": b""}

    def __call__(self, text) -> bytes:
        return bytes(next(self.many([text])))

    def many(self, texts, together: int = TOGETHER):
        """The ids of each text, in order. Texts of about `together` characters are held at once: fewer need less memory and more time."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= together:
                yield from self._group(group)
                group, size = [], 0
                pa.default_memory_pool().release_unused()
        yield from self._group(group)

    def _group(self, texts: list[str]):
        whole = [bool(_EXOTIC.search(t) or self.added and self.added.search(t)) for t in texts]
        plain = iter(self._plain([t for t, w in zip(texts, whole) if not w]))
        for t, w in zip(texts, whole):
            yield np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if w else next(plain)

    def _plain(self, texts: list[str]) -> list:
        chunks = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        # a "\n" ends each different chunk
        parts = self.split(unicodedata.normalize("NFC", "\n".join([*_listed(coded.dictionary), ""])))
        words = pa.array(parts, pa.large_string()).dictionary_encode()
        del parts
        which = words.indices.to_numpy()
        ends = which == words.dictionary.index("\n").as_py()
        times = np.bincount(coded.indices)[np.cumsum(ends) - ends]
        own = self._words(_listed(words.dictionary), np.bincount(which, times) > 1)
        at, data = _spliced(pa.array(own, pa.large_binary()), words.indices)
        at = np.concatenate([[0], at[1:][ends]])
        own = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), data])
        at, data = _spliced(own, coded.indices)
        starts, data = at[chunks.offsets.to_numpy()].tolist(), memoryview(data)
        return [data[a:b] for a, b in zip(starts, starts[1:])]

    def _words(self, words: list[str], again: np.ndarray) -> list[bytes]:
        """The ids of each of different words; "\n" has none. Those that occur `again` are kept."""
        own = list(map(self.known.get, words))
        new = [k for k, v in enumerate(own) if v is None]
        for at in range(0, len(new), 1000):
            some = new[at: at + 1000]
            for k, v in zip(some, self._merged([words[k] for k in some])):
                own[k] = v
        if len(self.known) >= _CACHE:
            self.known = {"\n": b""}
        self.known |= {words[k]: own[k] for k in np.flatnonzero(again)[:_CACHE].tolist()}
        return own

    def _merged(self, words: list[str]) -> list[bytes]:
        text = " ".join(words)
        if not text.isascii():
            text = self.letters[np.frombuffer(text.encode(), "u1")].tobytes().decode("utf-16-le")
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a word whose last token does not tell that it is the last
            return [np.array([t.id for t in self.tok.model.tokenize(w)], "<u4").tobytes() for w in text.split(" ")]
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist


def _spliced(values: pa.Array, which: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """The values that `which` names, joined: where each starts (and the last ends), and their bytes."""
    got = values.take(which)
    return np.frombuffer(got.buffers()[1], "<i8")[:len(got) + 1], got.buffers()[2]


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    key = (path, special_as_text)
    if key not in _READY:
        _READY[key] = Encoder(*key)
    return _READY[key]


def forget() -> None:
    _READY.clear()


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, max_tokens: int = MAX_TOKENS,
                 with_ids: bool = False, end_id: int = 0, special_as_text: bool = False, together: int = TOGETHER) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32 [, ids]): every document as ids plus the end id, in pieces of max_tokens.

    `row` tells apart input rows that share an id. Only documents longer than max_tokens are cut.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "id long, row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches):
        enc = encoder(tokenizer, special_as_text)
        for b in batches:
            ids, texts, keys = b.column(0), b.column(1), b.column(2).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for i, known in enumerate(enc.many((t.as_py() for t in texts), together)):
                data = b"".join((known, end))
                step = 4 * max_tokens
                for p, at in enumerate(range(0, len(data), step)):
                    piece = data[at: at + step]
                    for col, v in zip(out, (ids[i].as_py(), keys[i], p, at // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                        col.append(v)
                if with_ids and len(out[6]) >= 2000:
                    yield _batch(out, with_ids)
                    out = [[] for _ in range(7)]
            yield _batch(out, with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(tidied(run, forget), schema)


def _batch(cols, with_ids):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "row", "piece", "start", "length", "ids_crc32", "ids"]
    n = 7 if with_ids else 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])


def best_fit(lengths: np.ndarray, capacity=(2048, 2048, 2048 ** 2), weights=(1.0, 1.0, 1.0), rule: str = "norm"):
    """Vector best-fit decreasing: (bin, offset) of each piece.

    A piece needs (tokens, one document, tokens squared: its attention cost); a bin admits it only if every residual
    allows it. Of the bins that do, "norm" takes the one whose weighted residual after placing is smallest, "dot" the one
    whose residual has the largest weighted dot product with the piece; ties go to the older bin. Bins that not even
    the smallest piece left fits are closed, so the open list stays short.
    """
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = float(lengths[order[-1]]) if len(order) else 0.0
    room = np.empty((3, 64))
    label, opened, made = np.empty(64, np.int64), 0, 0
    scale = w / cap ** 2
    for seen, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        r = room[:, :opened]
        at = -1
        if opened:
            ok = (r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2])
            which = np.flatnonzero(ok)
            if which.size:
                c = r[:, which]
                score = (scale[:, None] * (c - need[:, None]) ** 2).sum(0) if rule == "norm" else -(scale[:, None] * c * need[:, None]).sum(0)
                at = which[int(score.argmin())]
        if at < 0:
            if opened == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], 1)
                label = np.concatenate([label, np.empty_like(label)])
            room[:, opened], label[opened] = cap, made
            at, opened, made = opened, opened + 1, made + 1
        bins[i], offsets[i] = label[at], cap[0] - room[0, at]
        room[:, at] -= need
        if room[0, at] < smallest or room[1, at] < 1:
            opened -= 1
            room[:, at], label[at] = room[:, opened], label[opened]
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_attention: int | None = None,
         block: int = BLOCK, rule: str = "norm") -> DataFrame:
    """Add sequence_id and offset to pieces (with columns id, row, piece, length).

    Pieces are dealt to blocks of about `block` by a hash, so every block holds the same mixture; each is packed by
    best_fit in one task. A block's last bins stay partly open, which costs about one sequence in a thousand.
    Capacities that are not given do not bind beyond the token limit.
    """
    pieces = materialize(pieces)
    n = max(1, -(-pieces.count() // block))
    caps = (max_tokens, max_docs or max_tokens, max_attention or max_tokens ** 2)
    fields = [f for f in pieces.schema if f.name != "__block"]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        bins, offs = best_fit(t["length"].to_numpy(), caps, rule=rule)
        base = t["__block"][0].as_py() * (1 << 32)
        return t.select(names).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offs))

    return (pieces.withColumn("__block", F.pmod(F.xxhash64("id", "row", "piece"), F.lit(n)))
            .groupBy("__block").applyInArrow(run, schema))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   max_tokens: int = MAX_TOKENS, with_ids: bool = False, special_as_text: bool = False,
                   together: int = TOGETHER, **kw) -> DataFrame:
    """Tokenise, cut and pack all documents: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone; rows that share an id are packed each. Very long texts become many full
    pieces. The string of a special token in a text is that token, as the tokenizer's file has it, unless
    `special_as_text`. Pieces of equal length are placed by id, row and number. Extra columns, of whatever name, are
    ignored; an empty table gives an empty result. The id must be an integer or a string of one.
    """
    pieces = token_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), max_tokens, with_ids,
                          special_as_text=special_as_text, together=together)
    cols = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack(pieces, max_tokens, **kw).select(F.col("id").alias(id_col), *cols)


def op9_packing(spark, sf_dir):
    return pack_documents(load(spark, sf_dir, "documents"))


SQL = None  # tested against the tokenizer as its file has it, and against a brute-force version of the placement rule
