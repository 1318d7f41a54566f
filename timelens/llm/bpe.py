"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie, held as their sorted list: neighbours' common prefixes are its shared paths.
A depth-first walk keeps one state for each letter of the path: the last token of that prefix's encoding, its length, and the place in
an automaton of token suffixes, which names the tokens that end there. A prefix ends with token t after a prefix whose last token is l
exactly if the merges leave the pair (l, t) apart, so each shared prefix is encoded once. A word's final letter
carries the end-of-word mark and is a leaf of its own.

Defined results: a null text is encoded as an empty one (no tokens); the exact strings of special tokens in a text become those
tokens; repeated rows are encoded alike, row by row; an empty table gives no rows; texts are encoded whole, at any length.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from timelens.llm.common import table, text_parts, worker_cache

#: A Python worker keeps the encodings of so many chunks of text, and the validity of so many pairs of tokens.
KEPT_CHUNKS, KEPT_PAIRS = 150_000, 300_000
#: Bytes of text handled at once.
SLICE = 2_000_000

_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or for the rest 256 and on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


# The library's tables are those of Unicode 16. Letters and numbers that came later are neither there, and capitals that came after
# Python's own tables have a lower case there.
_LATER = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
_LOWERED = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWERED |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = regex.compile("[" + "".join(map(chr, _LOWERED)) + "]")
#: Neither letter nor number nor space, and never assigned.
_OTHER = "\uffff"


class TokenSuffixes:
    """Automaton over letters. A place stands for the longest end of what was read that begins a token; it knows the tokens that end there."""

    def __init__(self, tokens: dict[str, int], end: str):
        self.moves: list[dict[str, int]] = [{}]
        self.up, self.letter, self.depth = array("i", [0]), array("i", [0]), array("i", [0])
        # the token that a whole place is, inside a word and at its end
        self.whole_inner, self.whole_final = array("i", [-1]), array("i", [-1])
        for t, i in tokens.items():
            final = t.endswith(end)
            place = 0
            for letter in t[: -len(end)] if final else t:
                place = self._child(place, letter)
            (self.whole_final if final else self.whole_inner)[place] = i
        self.falls: dict[int, int] = {0: 0}
        self.inner: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.moves)
        self.final: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.moves)

    def _child(self, place: int, letter: str) -> int:
        to = self.moves[place].get(letter)
        if to is None:
            to = self.moves[place][letter] = len(self.moves)
            self.moves.append({})
            for values, x in ((self.up, place), (self.letter, ord(letter)), (self.depth, self.depth[place] + 1), (self.whole_inner, -1), (self.whole_final, -1)):
                values.append(x)
        return to

    def fall(self, place: int) -> int:
        """The longest proper end of a place that is a place."""
        known = self.falls.get(place)
        if known is None:
            up = self.up[place]
            known = self.move(self.fall(up), chr(self.letter[place])) if up else 0
            self.falls[place] = known
        return known

    def move(self, place: int, letter: str) -> int:
        to = self.moves[place].get(letter)
        if to is None:
            to = self.move(self.fall(place), letter) if place else 0
            self.moves[place][letter] = to
        return to

    def ends(self, place: int) -> None:
        """Set (token, length) of the tokens that end at a place, longest first."""
        inner, final, at = [], [], place
        while at:
            for whole, out in ((self.whole_inner[at], inner), (self.whole_final[at], final)):
                if whole >= 0:
                    out.append((whole, self.depth[at]))
            at = self.fall(at)
        self.inner[place], self.final[place] = tuple(inner), tuple(final)


class WordBpe:
    """Encoder and decoder for a vocabulary file of the kind ``word_bpe``: words end with a mark, lower case, white space dropped."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        every = self.vocab | self.special
        self.token = [""] * (max(every.values()) + 1)
        for t, i in every.items():
            self.token[i] = t
        self.digits = [str(i) for i in range(len(self.token))]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.suffixes = TokenSuffixes(self.vocab, self.end)
        # for each pair of tokens the rank of its merge; for each token the two that it was merged from, and the rank of that
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[(a, b)] = n
            whole = self.vocab[self.token[a] + self.token[b]]
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = (a, b), n
        self.pairs: dict[int, bool] = {}
        # chunks of text by number; for each number its ids, its decoded text, how many ids, and how often it was met
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.text = pa.array([], pa.string()), pa.array([], pa.string())
        self.count = self.met = np.empty(0, np.int64)

    def _forget(self) -> None:
        """Drop chunks that were met once or twice; all of them, if that leaves too many."""
        often = np.flatnonzero(self.met > 2)
        if 2 * len(often) > KEPT_CHUNKS:
            often = often[:0]
        names, kept = list(self.index), pa.array(often)
        self.index = defaultdict(itertools.count(len(often)).__next__, {names[i]: n for n, i in enumerate(often.tolist())})
        self.ids, self.text = self.ids.take(kept), self.text.take(kept)
        self.count, self.met = self.count[often], np.zeros(len(often), np.int64)

    def _apart(self, last: int, token: int) -> bool:
        """Whether the merges leave token alone after last (at a word's start: after -1).

        Undoes the merges of both, the later one first, down to the letters next to the seam: no pair across the seam may have been
        merged before one of its sides was merged away. At equal ranks the left merge comes first.
        """
        if last < 0:
            return True
        rank, halves, made = self.rank, self.halves, self.made
        left, right, before = last, token, (1 << 60, 0)
        while True:
            across = rank.get((left, right))
            if across is not None and (across, 1) < before:
                return False
            of_left, of_right = made.get(left, -1), made.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            # a merge on the left of the seam goes before one of the same rank across it, and that before one on the right
            if of_left > of_right:
                left, before = halves[left][1], (of_left, 0)
            else:
                right, before = halves[right][0], (of_right, 2)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words, given as letters for bytes.

        For the first d letters of the path, last[d] is the last token of their encoding, size[d] its length, and place[d] where the automaton is.
        """
        suffixes, pairs, apart = self.suffixes, self.pairs, self._apart
        moves, inner, final = suffixes.moves, suffixes.inner, suffixes.final
        if len(pairs) >= KEPT_PAIRS:
            pairs.clear()
        out = {}
        path, last, size, place = "", [-1], [0], [0]
        for word in sorted(words):
            top = len(word) - 1
            depth, most = 0, min(len(path), top, len(last) - 1)
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :], place[depth + 1 :]
            at = place[depth]
            for letter in word[depth:]:
                to = moves[at].get(letter)
                at = suffixes.move(at, letter) if to is None else to
                if inner[at] is None:
                    suffixes.ends(at)
                ends = inner[at] if depth < top else final[at]
                depth += 1
                for token, n in ends:
                    before = last[depth - n]
                    key = (before + 1) << 20 | token
                    known = pairs.get(key)
                    if known is None:
                        known = pairs[key] = apart(before, token)
                    if known:
                        last.append(token)
                        size.append(n)
                        place.append(at)
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            path = word
            ids = []
            while depth:
                ids.append(last[depth])
                depth -= size[depth]
            ids.reverse()
            out[word] = ids
            # the final letter's state is no state of a prefix
            last.pop()
            size.pop()
            place.pop()
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that have just been numbered."""
        byte_letters, findall = self.letters, self.split
        # printable ASCII stands for itself, and a run of its letters is one piece
        cut = [
            [c] if c.isascii() and c.isalpha() else findall(c) if c.isascii() and c.isprintable() else [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_letters) for p in ([c[1:]] if c[0] == " " else findall(c))]
            for c in chunks
        ]
        marked = {n for n, c in enumerate(chunks) if c[0] == " "}
        words = self.encode_words({p for n, ps in enumerate(cut) if n not in marked for p in ps})
        digits, token = self.digits, self.token
        ids, text, count = [], [], []
        for n, (c, ps) in enumerate(zip(chunks, cut, strict=True)):
            if n in marked:
                found = [self.special[c[1:]]]
            else:
                found = words[ps[0]] if len(ps) == 1 else [i for p in ps for i in words[p]]
            ids.append(" ".join([digits[i] for i in found]))
            text.append(" ".join([token[i] for i in found]))
            count.append(len(found))
        self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.string())])
        self.text = pa.concat_arrays([self.text, pa.array(text, pa.string())])
        self.count = np.r_[self.count, np.array(count, np.int64)]

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space, with special tokens as chunks of their own, marked by a space."""
        if self.cut is not None and "<|" in text:
            return [c for i, part in enumerate(self.cut.split(text)) for c in ([" " + part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii() or not _LATER.search(chunk):
            return self.pieces.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pieces.finditer(_LATER.sub(_OTHER, chunk))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # a capital sigma is lowered without regard to what stands around it
            text = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
            if _CAPITALS.search(text):
                text = text.translate(_LOWERED)
        if _SEPARATORS.search(text):
            return [c for c in regex.split(r"\p{White_Space}+", text) if c]
        return text.split()

    def encode_batch(self, texts: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """For each text: its ids, joined by spaces, what they decode to, and their number."""
        if len(self.index) > KEPT_CHUNKS:
            self._forget()
        flat: list[str] = []
        ends = [0]
        for t in texts:
            flat += self.chunks(t)
            ends.append(len(flat))
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int32, len(flat))
        del flat
        if len(self.index) > known:
            self._learn(list(itertools.islice(self.index, known, None)))
        ends_ = np.array(ends, np.int64)
        taken, offsets = pa.array(at), pa.array(ends_.astype(np.int32))
        ids, text = (pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(taken)), " ") for x in (self.ids, self.text))
        total = np.r_[0, np.cumsum(self.count[at])]
        met = np.bincount(at, minlength=len(self.count))
        met[: len(self.met)] += self.met
        self.met = met
        return ids, text, total[ends_[1:]] - total[ends_[:-1]]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text: its ids, joined by spaces, and what they decode to."""
        ids, text, _ = self.encode_batch(texts)
        return zip(ids.to_pylist(), text.to_pylist(), strict=True)

    def encode(self, text: str) -> list[int]:
        ids, _ = next(self.encode_texts([text]))
        return [int(x) for x in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as this vocabulary has no decoder of its own."""
        return " ".join(self.token[i] for i in ids)


def loaded(source: str) -> WordBpe:
    """The encoder for a vocabulary's content, made once in each Python worker."""
    cache = worker_cache("bpe")
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in cache:
        cache[key] = WordBpe(source)
    return cache[key]


def vocabulary(path: str) -> str:
    """Content of a vocabulary file, read on the driver; its size is fixed, so executors get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            n, ids, decoded, listed = [], [], [], []
            for part in text_parts(batch.column(1), SLICE):
                a, b, counts = bpe.encode_batch(part)
                n += counts.tolist()
                ids += [hashlib.sha256(x.as_buffer()).hexdigest() for x in a]
                decoded += [hashlib.sha256(x.as_buffer()).hexdigest() for x in b]
                if with_ids:
                    listed += [[int(y) for y in x.split()] for x in a.to_pylist()]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                columns["token_ids"] = pa.array(listed, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), default_path())
