"""Operator 5, BPE encoding and decoding: tree concatenation.

Words between white space are encoded each for itself, and a Python worker keeps the ids of those that it has met. Text of more than
``LEAF`` characters is unsplit: it is halved down to leaves, wherever that cuts, the leaves are encoded side by side, and
the halves are joined pair by pair. A join encodes a window around its cut anew and lets it grow until its units and
those of either half agree, two in a row on each side. A unit is a word, or a token of a very long word; two adjacent
tokens that an encoding has given side by side are side by side in any encoding that has both at these places, so what
lies beyond them needs no second look. A window that reaches an end of the two halves takes that end as agreed.

Encoding is a narrow step; a text is never shuffled.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows repeat; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, kept_in_worker, texts_of

#: Characters up to which a text is encoded without being halved.
LEAF = 4_096
#: Characters from which a word counts as a text of its own, whose units are its tokens.
LONG_WORD = 256
#: Characters on either side of a cut that a window starts with.
WINDOW = 64
#: Distinct words that a Python worker keeps with their ids, from task to task.
WORDS_KEPT = 800_000

WORDS_AT_ONCE = 5_000
#: Characters of texts whose words are learned together.
TEXT_AT_ONCE = 4_000_000

#: Runs without the white space of Unicode, which the tokenizer drops.
WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])

#: Marks that may end a word, the apostrophe not among them, and the first letter that parts of words don't have.
MARKS = ".,;:!?#$%&*"
PLAIN = chr(0x130)

#: Places where units start, and each unit's ids.
Units = tuple[list[int], list[tuple[int, ...]]]


class TreeEncoder:
    """Encodes whole texts as the tokenizer file at ``path`` does."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        self.known: dict[str, tuple[int, ...]] = {}
        self.model = self.tokenizer.model
        self.ids = list(range(self.tokenizer.get_vocab_size()))
        self.numbers = [str(i) for i in self.ids]
        self.names = [self.tokenizer.id_to_token(i) for i in self.ids]
        self.direct = all(
            list(self.by_model(w)) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("a", "words", "überfülle")
        )

    def learn(self, found: list[list[str]]) -> None:
        """Encode the words of ``found`` that are not known yet."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        split = {w: parts(w) for w in set().union(*found).difference(self.known) if len(w) < LONG_WORD}
        pieces = set(chain.from_iterable(split.values())).difference(self.known)
        if self.direct:
            letters = [p for p in pieces if plain(p)]
            self.known.update(zip(letters, map(self.by_model, letters)))
            pieces.difference_update(letters)
        pieces = list(pieces)
        for i in range(0, len(pieces), WORDS_AT_ONCE):
            part = pieces[i:i + WORDS_AT_ONCE]
            for piece, ids in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[piece] = self.shared(ids.ids)
        for word, pair in split.items():
            if word not in self.known:
                self.known[word] = tuple(chain.from_iterable(map(self.known.__getitem__, pair)))

    def by_model(self, word: str) -> tuple[int, ...]:
        """The ids of lower-case Latin letters, which need no normalizing and no splitting, from the model alone."""
        spelled = word if word.isascii() else "".join([BYTE_LETTERS[b] for b in word.encode()])
        return self.shared([token.id for token in self.model.tokenize(spelled)])

    def shared(self, ids: list[int]) -> tuple[int, ...]:
        """The ids as numbers of which there is one object each."""
        return tuple(map(self.ids.__getitem__, ids))

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.shared(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(word) < LONG_WORD:
                self.known[word] = ids
        return ids

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.known.get, words))
        return list(map(self.word, words)) if None in found else found

    def units(self, text: str, first: int = 0, words: list[str] | None = None) -> Units:
        """The units of a text that begins at the place ``first``; ``words`` are its words if they are known."""
        words = WORD.findall(text) if words is None else words
        if not words:
            return [], []
        lengths = list(map(len, words))
        begin, end = text.index(words[0]), text.rindex(words[-1]) + lengths[-1]
        if sum(lengths) + len(words) - 1 == end - begin:
            # One character between any two words.
            places = list(accumulate([first + begin, *[n + 1 for n in lengths[:-1]]]))
        else:
            places = [m.start() + first for m in WORD.finditer(text)]
        if max(lengths) < LONG_WORD:
            return places, self.words(words)
        starts: list[int] = []
        ids: list[tuple[int, ...]] = []
        for word, at in zip(words, places):
            if len(word) < LONG_WORD:
                starts.append(at)
                ids.append(self.word(word))
                continue
            found = self.tokenizer.encode(word, add_special_tokens=False)
            for token, (begin, _) in zip(found.ids, found.offsets):
                # Tokens that share a character are one unit.
                if starts and starts[-1] == at + begin:
                    ids[-1] += (token,)
                else:
                    starts.append(at + begin)
                    ids.append((token,))
        return starts, ids

    def join(self, text: str, low: int, cut: int, high: int, left: Units, right: Units) -> Units:
        """The units of text[low:high] from those of its parts before and after ``cut``."""
        reach = self.window
        while True:
            begin, end = max(low, cut - reach), min(high, cut + reach)
            starts, ids = middle = self.units(text[begin:end], begin)
            take, give = (0, 0) if begin == low else agreed(middle, left, range(1, len(starts) - 1))
            until, onward = (len(starts), len(right[0])) if end == high else agreed(
                middle, right, range(len(starts) - 3, 0, -1), least=1
            )
            if take is not None and until is not None and take <= until:
                return (
                    left[0][:give] + starts[take:until] + right[0][onward:],
                    left[1][:give] + ids[take:until] + right[1][onward:],
                )
            reach *= 4

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """Begin and end of a text's leaves; the last halving of a text gives these."""
        cuts = [*range(0, max(len(text), 1), self.leaf), len(text)]
        return list(zip(cuts, cuts[1:]))

    def whole(self, text: str, found: list[list[str]]) -> Units:
        """The units of a text of any length, by halves; ``found`` are the words of its leaves."""
        halves = [(a, b, self.units(text[a:b], a, words)) for (a, b), words in zip(self.leaves(text), found)]
        while len(halves) > 1:
            pairs = [
                (a, d, self.join(text, a, b, d, left, right))
                for (a, b, left), (_, d, right) in zip(halves[::2], halves[1::2])
            ]
            halves = pairs + halves[2 * len(pairs):]
        return halves[0][2]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. The leaves of all of them are encoded side by side."""
        cuts = [self.leaves(t) for t in texts]
        found = [WORD.findall(t[a:b]) for t, own in zip(texts, cuts) for a, b in own]
        self.learn(found)
        out, at = [], 0
        for text, own in zip(texts, cuts):
            words, at = found[at:at + len(own)], at + len(own)
            units = self.words(words[0]) if len(own) == 1 else self.whole(text, words)[1]
            out.append(list(chain.from_iterable(units)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def spelled(self, ids: list[int]) -> str:
        """The ids in decimal, joined by a space."""
        return " ".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer.decoder is None:
            # Then the library joins the tokens by a space.
            return " ".join(map(self.names.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it is printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def plain(letters: str) -> bool:
    return letters.isalpha() and max(letters) < PLAIN


def parts(word: str) -> tuple[str, ...]:
    """Parts of a word that the tokenizer separates too: Latin letters, in lower case, and a run of marks after them.

    Below PLAIN every letter has one lower-case letter and nothing combines, so a part's ids don't depend on the other.
    """
    letters = word.rstrip(MARKS)
    if plain(letters):
        return (letters.lower(), word[len(letters):])[:1 + (len(letters) < len(word))]
    return (word,)


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, some ``TEXT_AT_ONCE`` characters at a time."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TEXT_AT_ONCE:
            yield part
            part, size = [], 0
    yield part


def agreed(window: Units, half: Units, order: range, least: int = 0) -> tuple[int | None, int | None]:
    """The first place, in ``order``, of two units in a row that a window and a half share; its number in either."""
    starts, ids = window
    for i in order:
        j = bisect_left(half[0], starts[i])
        if (
            least <= j < len(half[0]) - 1 and half[0][j:j + 2] == starts[i:i + 2] and half[1][j:j + 2] == ids[i:i + 2]
        ):
            return i, j
    return None, None


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trips(documents: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("tree encoder", path), lambda: TreeEncoder(path))
        for rows in batches:
            out: list[tuple] = []
            names = iter(rows.column("doc_id").to_pylist())
            for texts in slices(texts_of(rows.column("text"))):
                for ids in encoder.encode_all(texts):
                    out.append((next(names), len(ids), digest(encoder.spelled(ids)), digest(encoder.decode(ids))))
            yield batch(ROW, list(zip(*out)) if out else [[]] * len(ROW))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
