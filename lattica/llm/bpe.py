"""BPE encoding and decoding by a prefix-sharing trie traversal.

Distinct words of a chunk are visited in sorted order, which is a depth-first walk of their trie.  Each prefix
has one state, the last token of its encoding, so a word starts from the states of the prefix that it shares with
the word before.  The last token of a prefix is the one that ends there and may follow the last token of what is
left before it: two tokens may stand side by side if undoing their merges, latest first, never shows a merge
across their border that BPE would have made earlier.  A word's encoding is read back from the last tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import prepare, releasing

#: Encodings of pieces, and of words, that a worker keeps for later chunks: two generations of so many each at most.
KEPT_WORDS = 60_000
CHUNK_CHARS = 1_000_000
#: Bytes of a word that states are asked for at once.
DEPTH = 200
#: Last bytes of a prefix that its tokens are first looked for with, and at most; longer tokens are asked for by length.
NEAR, FAR = 4, 6
#: Letters below this code point are letters in every version of Unicode.
LATIN_END = "\u0250"
MARKS = ".,;:!?"

# Fixed value: how this tokenizer splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE file (the tokenizers library's JSON), by bytes and by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letter = byte_letters()
        model = held["model"]
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.id = {as_bytes(k): v for k, v in model["vocab"].items()}
        self.bytes: dict[int, bytes] = {v: k for k, v in self.id.items()}
        # rank 0 is for single bytes, which no merge makes
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, both = self.id[a], self.id[b], self.id[a + b]
            self.merge[a, b] = k + 1
            if both not in self.rank:
                self.rank[both], self.parts[both] = k + 1, (a, b)
        self.special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes.setdefault(i, text.encode())
        self.endings = self._endings()
        self._fits: dict[int, bool] = {}
        size = max(self.bytes) + 1
        self.length = np.array([len(self.bytes.get(i, b"")) for i in range(size)], np.int64)
        self.first = np.r_[0, np.cumsum(self.length)]
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)

    def _endings(self) -> dict[bytes, tuple[bool | tuple[int, ...], tuple[tuple[int, int, bytes], ...]]]:
        """For every ending of a token, of ``FAR`` bytes at most, what is longer, and the tokens in it, longest first.

        What is longer: whether a longer ending ends with it; at ``FAR`` bytes, the lengths of tokens that do, longest
        first.  A token is given by its length, its id and the packed id.
        """
        longer: dict[bytes, bool] = {}
        lengths: dict[bytes, set[int]] = {}
        for token in self.id:
            end = token[-FAR:]
            longer.setdefault(end, False)
            if len(token) > FAR:
                lengths.setdefault(end, set()).add(len(token))
            for k in range(1, len(end)):
                if longer.get(end[k:]):
                    break  # and so are all shorter endings
                longer[end[k:]] = True
        found: dict[bytes, tuple[bool | tuple[int, ...], tuple[tuple[int, int, bytes], ...]]] = {}
        for end in sorted(longer, key=len):
            token, shorter = self.id.get(end), found[end[1:]][1] if len(end) > 1 else ()
            more = longer[end] if len(end) < FAR else tuple(sorted(lengths.get(end, ()), reverse=True))
            found[end] = more, shorter if token is None else ((len(end), token, pack("<I", token)), *shorter)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE keeps tokens a and b apart when they are neighbours."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        left, right = self.rank.get(a, 0), self.rank.get(b, 0)
        # merges are undone from the latest back; a border merge counts if it came before those still standing
        limit = 1 << 60
        while True:
            border = self.merge.get((a, b))
            if border is not None and border < limit:
                return False
            if left == right == 0:
                return True
            if left > right:  # of two equal ranks, the left one was merged first
                limit, a = left, self.parts[a][1]
                left = self.rank.get(a, 0)
            else:
                limit, b = right + 1, self.parts[b][0]
                right = self.rank.get(b, 0)

    def encode_sorted(self, words: list[bytes]) -> list[bytes]:
        """Encodings (packed ids) of distinct words in sorted order, each prefix handled once.

        A word asks for the state of its whole, that asks for the prefixes which the tokens that may end there leave,
        and so on; prefixes that no token leaves are not visited.
        """
        ids, fits, known, endings, out = self.id.get, self.fits, self._fits.get, self.endings.get, []
        last: list[int | None] = [-1]  # last[d]: the last token of the first d bytes; -2: none, None: not asked for yet
        code = [b""] * (DEPTH + 1)  # code[d]: the encoding of the first d bytes, where last[d] is a token
        word = before = b""

        def state(d: int) -> int:
            k = d if d < NEAR else NEAR
            found = endings(word[d - k : d])
            if found is None:
                while found is None and k:
                    k -= 1
                    found = endings(word[d - k : d])
                if found is None:  # a byte that ends no token
                    last[d] = -2
                    return -2
            else:
                while found[0] and k < d and k < FAR:
                    more = endings(word[d - k - 1 : d])
                    if more is None:
                        break
                    found, k = more, k + 1
            tokens = found[1]
            if k == FAR and found[0]:
                more = [(n, ids(word[d - n : d])) for n in found[0] if n <= d]
                tokens = [*((n, token, pack("<I", token)) for n, token in more if token is not None), *tokens]
            for n, token, packed in tokens:
                b = d - n
                if b:
                    ahead = last[b]
                    if ahead is None:
                        ahead = state(b)
                    if ahead < 0:
                        continue
                    apart = known(ahead << 32 | token)
                    if not apart and (apart is not None or not fits(ahead, token)):
                        continue
                last[d] = token
                if d <= DEPTH:
                    code[d] = code[b] + packed
                return token
            last[d] = -2
            return -2

        for word in words:  # noqa: B007  state() reads it
            end, shared, most = len(word), 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            last[shared + 1 :] = [None] * (end - shared)
            for d in range(DEPTH, end, DEPTH):  # so that a very long word asks no deeper than this
                if last[d] is None:
                    state(d)
            if last[end] is None:
                state(end)
            if end <= DEPTH and last[end] >= 0:
                out.append(code[end])
            else:
                tokens, d = [], end
                while d:
                    tokens.append(last[d])
                    d -= len(self.bytes[last[d]])
                tokens.reverse()
                out.append(pack(f"<{len(tokens)}I", *tokens))
            before = word
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after another."""
        if not len(ids):
            return b""
        n = self.length[ids]
        begin = np.cumsum(n) - n
        return self.flat[np.arange(n.sum()) + np.repeat(self.first[ids] - begin, n)].tobytes()


class Encoder:
    """Encodes texts with encodings of pieces that it has met; one per Python worker and vocabulary.

    A piece is what stands between single spaces.  A space with something other than white space on both sides
    always begins a word of its own, so pieces can be split into words one by one; texts in which a space touches
    other white space are split as a whole.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # whether a special token may stand within letters and marks
        self.wordy = any(all(c.isalpha() or c == " " or c in MARKS for c in x) for x in names)
        # whether a special token may stand within letters and marks
        self.wordy = any(all(c.isalpha() or c == " " or c in MARKS for c in x) for x in names)
        self.lead: dict[str, bytes | None] = {}  # pieces at the start of a text
        self.rest: dict[str, bytes | None] = {}  # pieces after a space; also the words that they start with, so that pieces share them
        self.inner: dict[str, bytes] = {}  # words that start within a piece
        self.old_lead, self.old_rest, self.old_inner = self.lead, self.rest, self.inner  # the generation before, for those that come back

    def forget(self) -> None:
        """Drop the kept encodings, so that an idle worker holds the vocabulary only."""
        for held in (self.lead, self.rest, self.inner, self.old_lead, self.old_rest, self.old_inner, self.vocabulary._fits):
            held.clear()

    def _words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def _encode(self, words: set[str], known: dict[str, bytes | None], old: dict[str, bytes | None], space: str = "") -> None:
        """Have the encodings of ``words`` (after ``space``) in ``known``: each new word is encoded once, along the trie of them all."""
        new = []
        for w in words:
            if known.get(w) is None:
                code = old.get(w)
                if code is None:
                    new.append(w)
                else:
                    known[w] = code
        new.sort()  # code points have the order of their UTF-8
        known.update(zip(new, self.vocabulary.encode_sorted([(space + w).encode() for w in new]), strict=True))

    def _joined(self, splits: list[list[str]]) -> list[bytes]:
        """The encodings of texts that are split into words and special tokens."""
        special = self.vocabulary.special
        self._encode(set().union(*splits) - special.keys(), self.inner, self.old_inner)
        return [b"".join([pack("<I", special[w]) if w in special else self.inner[w] for w in words]) for words in splits]

    def _stands(self, piece: str, space: str) -> bool:
        """Whether a piece is split as it is, whatever its neighbours are."""
        return bool(piece) and not piece[0].isspace() and not piece[-1].isspace() and not (self.special and self.special.search(space + piece))

    def _learn_lead(self, pieces: set[str]) -> None:
        plain = [p for p in pieces if self._stands(p, "")]
        self.lead.update(dict.fromkeys(pieces))
        self.lead.update(zip(plain, self._joined([self.split.findall(p) for p in plain]), strict=True))

    def _learn_rest(self, pieces: set[str]) -> None:
        """Latin letters, with a mark at the end or without, need no pattern."""
        rest, old, inner = self.rest, self.old_rest, self.inner
        back = pieces & old.keys()
        for p in back:
            rest[p] = old[p]
        pieces -= back
        letters = set() if self.wordy else {p for p in pieces if p.isalpha() and (p.isascii() or max(p) < LATIN_END)}
        marked: list[tuple[str, str, str]] = []  # piece, its letters, its mark
        split: list[tuple[str, str, list[str]]] = []  # piece, its first word, the others
        for p in pieces - letters:
            w = p[:-1]
            if w.isalpha() and p[-1] in MARKS and (w.isascii() or max(w) < LATIN_END) and not self.wordy:
                marked.append((p, w, p[-1]))
            elif self._stands(p, " "):
                first, *others = self.split.findall(" " + p)
                split.append((p, first[1:], others))
            else:
                rest[p] = None
        letters.update([w for _, w, _ in marked], [w for _, w, _ in split])
        self._encode(letters, rest, old, " ")
        self._encode(set(MARKS).union(*[x for _, _, x in split]), inner, self.old_inner)
        for p, w, mark in marked:
            rest[p] = rest[w] + inner[mark]
        for p, w, others in split:
            rest[p] = rest[w] + b"".join([inner[x] for x in others])

    def texts(self, texts: list[str], chunk: int = CHUNK_CHARS) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; a special token's string is that token.

        New pieces of about ``chunk`` characters of text are encoded together; the ids don't depend on it.
        """
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
                size += len(texts[end])
                end += 1
            if len(self.lead) + len(self.rest) > KEPT_WORDS:
                self.old_lead, self.old_rest, self.lead, self.rest = self.lead, self.rest, {}, {}
            if len(self.inner) > KEPT_WORDS:
                self.old_inner, self.inner = self.inner, {}
            split = [t.split(" ") for t in texts[at:end]]
            first = [p.pop(0) for p in split]
            rest = self.rest
            self._learn_lead(set(first) - self.lead.keys())
            self._learn_rest({w for p in split for w in p if w not in rest})
            for t, a, p in zip(texts[at:end], first, split, strict=True):
                try:
                    out.append(self.lead[a] + b"".join(map(rest.__getitem__, p)))
                except TypeError:  # a piece that does not stand by itself
                    out += self._joined([self._words(t)])
            at = end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    return encoder(path).texts(texts)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of each whole text, one row per input row, without added specials.

    Null and empty texts have no tokens.  Null and repeated ids and extra columns do not matter; an empty table
    gives an empty result.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = encode_texts([t or "" for t in batch.column("text").to_pylist()], path)
            cut = np.r_[0, np.cumsum([len(c) // 4 for c in coded])].astype(np.int32)
            flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["id", "ids"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(make), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text) from (id, ids): the texts that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            lists = batch.column("ids")
            flat, cut = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            texts = [vocabulary.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "ids").mapInArrow(make, f"id {kind}, ids array<int>, text string")


def encode_decode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_tokens, ids binary, text) in one pass: ids as little-endian unsigned 32-bit integers, text decoded from them.

    A smaller ``chunk`` (characters whose new pieces are encoded together) takes less memory and more time.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            coded = own.texts([t or "" for t in batch.column("text").to_pylist()], chunk)
            texts = [own.vocabulary.decode(np.frombuffer(c, "<u4").astype(np.int64)).decode("utf-8", "replace") for c in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(texts, pa.string())],
                names=["id", "n_tokens", "ids", "text"])
        own.forget()

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(make), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, text string")
