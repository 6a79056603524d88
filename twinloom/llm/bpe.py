"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is given by its last token and the encoding of what precedes it; a token
may follow another exactly if encoding the two together gives just these two. So the distinct
words of a task form a trie, and going down it each node needs its last token only, found once
for all words that share the prefix. The trie is walked as sorted words with a stack, depth
first, so it is never held as a whole.

The tokenizer file describes word-end symbols, a letter / digit / other splitter, and no decoder:
decoded text is the tokens with blanks between them.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import fresh, give_back, slices

END = "</w>"
# Bytes of words, and of chunks between blanks, whose encodings a worker remembers; forgetting costs time only.
REMEMBERED = 128 << 20
# What an entry takes beside its text and ids.
ENTRY = 200
# Pairs of tokens whose answer a worker remembers.
PAIRS = 1_000_000
# Texts whose words are encoded as one trie.
TOGETHER = 500


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _taken(entries: dict[str, bytes]) -> int:
    return sum(len(k) + len(v) + ENTRY for k, v in entries.items())


class WordBpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        # token text -> id, without and with the word end
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}
        self.sizes = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.starts = {t[:n] for t in (*self.inner, *self.final) for n in range(1, len(t) + 1)}
        self.rank: dict[tuple[int, int], int] = {}
        # token -> (rank of the merge that makes it, its parts)
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = (vocab[a], vocab[b])
            self.rank[pair] = rank
            self.made[vocab[a + b]] = (rank, *pair)
        special = "|".join(map(regex.escape, self.special))
        self.split_special = regex.compile(f"({special})") if special else None
        # The splitter of the tokenizer file, without its look at white space.
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
        ).findall
        # Ids are kept as little-endian 32-bit numbers in bytes: small, and nothing to collect.
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self.held = 0

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the texts of ``a`` and ``b`` together gives ``a, b``.

        The boundary is followed back in time: the later of the two was merged last, so before
        that its part touched the other. The boundary gives way if a pair across it would have
        been merged before either of them went into its successor. Equal merges go from the left.
        """
        a_gone = b_gone = len(self.rank)
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < a_gone and across <= b_gone:
                return False
            a_made, b_made = self.made.get(a), self.made.get(b)
            if a_made is None and b_made is None:
                return True
            if b_made is None or (a_made is not None and a_made[0] > b_made[0]):
                a_gone, a = a_made[0], a_made[2]
            else:
                b_gone, b = b_made[0], b_made[1]

    def _last(self, word: str, length: int, reach: int, lasts: list[int], table: dict[str, int]) -> int:
        """Last token of ``word[:length]``; ``lasts`` has those of the shorter prefixes.

        ``reach`` is the most letters before ``length`` that may be a token.
        """
        for start in range(length - reach, length):
            token = table.get(word[start:length])
            if token is not None:
                if start:
                    pair = lasts[start] << 32 | token
                    fits = self.follows.get(pair)
                    if fits is None:
                        if len(self.follows) >= PAIRS:
                            self.follows.clear()
                        fits = self.follows[pair] = self._may_follow(lasts[start], token)
                else:
                    fits = self._alone(token)
                if fits:
                    return token
        raise ValueError(f"no encoding of {word[:length]!r}")

    def _alone(self, token: int) -> bool:
        made = self.made.get(token)
        return made is None or self.rank.get(made[1:]) == made[0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, given in the letters that stand for bytes.

        Sorted words are the trie's leaves in depth-first order; the two lists are the path from
        its root, and what a word shares with the one before it is not computed again.
        """
        found: dict[str, bytes] = {}
        lasts: list[int] = [-1]
        # Letters before each node that begin some token: at most one more than at its parent.
        reaches: list[int] = [0]
        starts, finals = self.starts, self.final
        before = ""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del lasts[shared + 1 :], reaches[shared + 1 :]
            size = len(word)
            for length in range(len(lasts), size):
                reach = reaches[-1] + 1
                while reach and word[length - reach : length] not in starts:
                    reach -= 1
                reaches.append(reach)
                lasts.append(self._last(word, length, reach, lasts, self.inner))
            reach = reaches[size - 1] + 1
            while reach and word[size - reach :] not in finals:
                reach -= 1
            end = self._last(word, size, reach, lasts, self.final)
            ids, at = [end], size - self.sizes[end]
            while at:
                ids.append(lasts[at])
                at -= self.sizes[lasts[at]]
            ids.reverse()
            found[word] = pack(f"<{len(ids)}I", *ids)
            before = word
        return found

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text, as the tokenizer file normalises and splits it."""
        found: list[str] = []
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                found.append(part)
                continue
            clean = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found += self.pieces(clean)
        return found

    def _encode_chunks(self, chunks: set[str]) -> None:
        """Remember the ids of chunks without blanks: normalising and splitting stay inside one."""
        words = {chunk: self.words(chunk) for chunk in chunks}
        new = {w for found in words.values() for w in found} - self.known_words.keys()
        special = self.special.keys() & new
        made = {w: pack("<I", self.special[w]) for w in special}
        spelled = {w: w.encode().decode("latin-1").translate(self.to_letters) for w in new - special}
        encoded = self.encode_words(spelled.values())
        made.update((w, encoded[s]) for w, s in spelled.items())
        known = self.known_words
        known.update(made)
        whole = {c: b"".join([known[w] for w in found]) for c, found in words.items()}
        self.known.update(whole)
        self.held += _taken(made) + _taken(whole)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        chunks = set(chain.from_iterable(split))
        if self.held > REMEMBERED:
            self.known, self.known_words = {c: self.known[c] for c in chunks if c in self.known}, {}
            self.held = _taken(self.known)
        self._encode_chunks(chunks - self.known.keys())
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, chunks)), "<u4") for chunks in split]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(spec: str) -> WordBpe:
    model = WordBpe(json.loads(spec))
    gc.freeze()  # its tables stay for the worker's life; no need to walk them again
    return model


def tokenizer_spec(spark, path: str) -> str:
    """The tokenizer file, read on the driver; it travels to the tasks with the job."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as file:
        return file.read()


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _encoded(batches: Iterable[pa.RecordBatch], spec, text_at: int, ids_name: str):
    model = _loaded(spec.value)
    for batch in slices(batches, TOGETHER):
        ids = model.encode_batch(_texts(batch.column(text_at)))
        offsets = np.cumsum([0, *map(len, ids)])
        values = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, ids_name])
        give_back()


def encode(docs: DataFrame, tokenizer: str, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``; a missing or empty text has none.

    Repeated rows repeat, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_spec(spark, tokenizer))
    text_at, name = docs.columns.index("text"), fresh(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda b: _encoded(b, spec, text_at, name), schema)


def _decoded(batches: Iterable[pa.RecordBatch], spec, ids_at: int, name: str):
    model = _loaded(spec.value)
    for batch in slices(batches, TOGETHER):
        texts = [model.decode(i or []) for i in batch.column(ids_at).to_pylist()]
        made = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the tokens of ``ids`` as text; missing or no ids give an empty text.

    Repeated rows repeat, and an empty table gives no rows. An id that the file lacks is an error.
    """
    spark = encoded.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_spec(spark, tokenizer))
    ids_at, name = encoded.columns.index(ids), fresh(encoded, name)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    return encoded.mapInArrow(lambda b: _decoded(b, spec, ids_at, name), schema)


DIGEST = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(batches: Iterable[pa.RecordBatch], spec):
    model = _loaded(spec.value)
    for batch in slices(batches, TOGETHER):
        ids = model.encode_batch(_texts(batch.column(1)))
        sha = hashlib.sha256
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(map(len, ids), pa.int64()),
                pa.array(sha(i.tobytes()).hexdigest() for i in ids),
                pa.array(sha(model.decode(i.tolist()).encode()).hexdigest() for i in ids),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of encoding and decoding in one pass, so that ids needn't leave the task.

    One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. A missing text is
    empty: no tokens, and the digests of nothing. Repeated rows repeat; other columns are unread.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_spec(spark, tokenizer))
    source = docs.select("doc_id", "text")
    schema = DIGEST.format(source.schema["doc_id"].dataType.simpleString())
    return source.mapInArrow(lambda b: _digests(b, spec), schema)
