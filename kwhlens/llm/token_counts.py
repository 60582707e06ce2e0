"""Token counts of whole texts by compiled finite-state transducers, without token ids.

Two transducers are compiled from a tokenizer file (byte-level BPE whose words end in a suffix):

* The splitter reads classes of characters and cuts a text into the pieces that merges
  never cross.  Its states are few, so a run of characters is a map from states to states.  The
  runs' maps are composed by a parallel prefix scan (all runs at once, in NumPy), which gives
  each run its state at the beginning; then all runs are cut at once.
* The counter reads the bytes of a piece.  Its transitions are annotated with the number of tokens by
  which the count changes, and with the change if the piece ends there.  A state holds, for each
  earlier position that a longer token could still begin at, the place in the vocabulary's trie, the last token
  of the merges up to there, and the difference of counts.  The last token of any beginning is unique:
  a sequence of tokens is the result of the merges just if each two neighbours are their own
  result.  States and transitions are made when they are first needed, kept by the Python
  worker and begun anew at a bound, so long pieces cost no more than their length.

Distinct pieces are counted once and kept in a bounded table.  Long texts are read
in parts; a piece that goes on in the next part is carried over as the counter's state.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kwhlens.llm.words import mix, parts, tidy

#: Transitions kept by the counter (some 150 bytes each), and pieces by a worker (16 bytes each), at most.
MOST_TRANSITIONS, MOST_PIECES = 600_000, 3_000_000
#: Characters read at once, and of a run of the splitter's prefix scan.
PART, RUN = 1 << 18, 128

# ---------------------------------------------------------------- splitter
#: Fixed value: the split pattern that the splitter is compiled from.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of characters: white space, number, other mark, apostrophe, other letter, and the letters of the
#: short forms: those that end one by themselves, and r, v, l, e.
_SPACE, _NUMBER, _MARK, _QUOTE, _LETTER, _ONE, _R, _V, _L, _E = range(10)
#: States: nothing open (also after a number or a short form), in letters, in marks, after an
#: apostrophe that begins a piece, and after that and r, v or l.
_NONE, _LETTERS, _MARKS, _QUOTED, _QUOTED_R, _QUOTED_V, _QUOTED_L = range(7)


def _splitter() -> np.ndarray:
    """The state after each state and class of character."""
    step = np.empty((7, 10), np.uint8)
    step[:, _SPACE] = step[:, _NUMBER] = _NONE
    step[:, _MARK] = _MARKS
    step[:, _QUOTE] = _QUOTED
    step[[_MARKS, _QUOTED], _QUOTE] = _MARKS
    step[:, _LETTER:] = _LETTERS
    step[_QUOTED, _ONE] = _NONE
    step[_QUOTED, [_R, _V, _L]] = [_QUOTED_R, _QUOTED_V, _QUOTED_L]
    step[_QUOTED_R, _E] = step[_QUOTED_V, _E] = step[_QUOTED_L, _L] = _NONE
    return step


_STEP = _splitter()
#: Classes of the characters seen so far (255: not yet); filled by asking the library.
_classes = np.full(0x110000, 255, np.uint8)


def scan_states(classes: np.ndarray, state: int, run: int = RUN) -> np.ndarray:
    """The splitter's state before each character and, as one more entry, after the last."""
    n = len(classes)
    rows = -(-n // run)
    padded = np.zeros(rows * run, np.uint8)
    padded[:n] = classes
    padded = np.ascontiguousarray(padded.reshape(rows, run).T)
    maps = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for column in padded:  # each run's map, all runs at once
        maps = _STEP[maps, column[:, None]]
    width = 1
    while width < rows:  # inclusive prefix scan: entry i becomes the map of runs 0 to i
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], 1)
        width *= 2
    states = np.empty((run + 1, rows), np.uint8)
    states[0, 0] = state
    states[0, 1:] = maps[:-1, state]
    for k in range(run):
        states[k + 1] = _STEP[states[k], padded[k]]
    out = np.empty(n + 1, np.uint8)
    out[:n] = states[:run].T.reshape(-1)[:n]
    out[n] = states[(n - 1) % run + 1, (n - 1) // run]
    return out


def piece_starts(classes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character; the part must not end inside a short form."""
    before, after = states[:-1], states[1:]
    letter = classes >= _LETTER
    start = (classes == _NUMBER) | ((classes == _MARK) & (before != _MARKS) & (before != _QUOTED))
    start |= after == _QUOTED
    start |= letter & ((before == _NONE) | (before == _MARKS))
    # after an apostrophe: a letter goes on with it only in a short form
    ends_short = (before == _QUOTED) & (classes == _ONE)
    long_short = np.zeros(len(classes), bool)
    pending = after >= _QUOTED_R
    long_short[:-1] = pending[:-1] & (after[1:] == _NONE) & (classes[1:] >= _LETTER)
    start |= letter & (before == _QUOTED) & ~ends_short & ~long_short
    return start


# ----------------------------------------------------------------- counter
def _byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in byte-level vocabularies: printable ones by themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Counter:
    """The counting transducer of a vocabulary and its merges."""

    def __init__(self, model: dict, most: int = MOST_TRANSITIONS):
        self.suffix, self.most = model["end_of_word_suffix"], most
        byte = _byte_letters()
        self.rank: dict[tuple, tuple[int, int]] = {}  # (token, token): rank and merged token
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # 512 first symbols: byte, and byte at the end of a word
        self.first = np.array([[vocab[c], vocab[c + self.suffix]] for c in sorted(byte, key=byte.get)])
        spelled: dict[int, tuple] = {int(t): (i % 256,) for i, t in enumerate(self.first.T.ravel())}
        ended = set(self.first[:, 1].tolist())
        for r, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            new = vocab[a + b]
            self.rank[x, y] = (r, new)
            spelled[new] = spelled[x] + spelled[y]
            if y in ended:
                ended.add(new)
        # the vocabulary's trie: children by byte; the token that ends there, inside and at the end of a word
        self.child: list[dict[int, int]] = [{}]
        self.inside, self.at_end = [-1], [-1]
        for token, path in spelled.items():
            if self._merged(path, token in ended) != [token]:
                continue  # never a result
            at = 0
            for b in path:
                if b not in self.child[at]:
                    self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.inside.append(-1)
                    self.at_end.append(-1)
                at = self.child[at][b]
            (self.at_end if token in ended else self.inside)[at] = token
        self.path = spelled
        self.ended = ended
        self.neighbours: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: ((place in the trie, last token before it, count less the count so far), ...), longest first
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int, int]] = {}

    def _merged(self, path: tuple, at_end: bool) -> list[int]:
        """The merges' result of a sequence of bytes: the least rank first, of equal ones the leftmost."""
        tokens = [int(self.first[b, 0]) for b in path]
        if at_end:
            tokens[-1] = int(self.first[path[-1], 1])
        while len(tokens) > 1:
            best = min((self.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(tokens, tokens[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            tokens[i : i + 2] = [self.rank[tokens[i], tokens[i + 1]][1]]
        return tokens

    def _follows(self, a: int, b: int) -> bool:
        """Whether the merges keep tokens a and b apart when b follows a."""
        key = a << 32 | b
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > self.most:
                self.neighbours.clear()
            known = self.neighbours[key] = self._merged(self.path[a] + self.path[b], b in self.ended) == [a, b]
        return known

    def move(self, state: int, byte: int) -> tuple[int, int, int]:
        """(state after it, change of the count, change if the piece ends with this byte)."""
        live, last, count, end = [], -1, None, None
        for place, token, less in self.states[state]:
            to = self.child[place].get(byte)
            if to is None:
                continue
            live.append((to, token, less))
            inside, at_end = self.inside[to], self.at_end[to]
            if inside >= 0 and count is None and (token < 0 or self._follows(token, inside)):
                last, count = inside, less + 1
            if at_end >= 0 and end is None and (token < 0 or self._follows(token, at_end)):
                end = less + 1
        after = tuple([(p, t, less - count) for p, t, less in live if self.child[p]] + [(0, last, 0)])
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        found = self.moves[state << 8 | byte] = (number, count, end)
        return found

    def run(self, piece: bytes, state: int = 0, count: int = 0) -> tuple[int, int, int]:
        """(state, count, count if the piece ends here) after the bytes of ``piece`` (at least one)."""
        moves, end = self.moves, 0
        for b in piece:
            found = moves.get(state << 8 | b)
            if found is None:
                found = self.move(state, b)
            state, more, last = found
            end = count + last
            count += more
        return state, count, end

    def tidy_up(self) -> None:
        """Begins anew if the transducer has grown to its bound; only between pieces."""
        if len(self.moves) > self.most:
            self._reset()


class TokenCounter:
    """Token counts of texts as the tokenizers library gives them, without special tokens of its own.

    Takes a byte-level BPE file whose split pattern is ``PATTERN``, whose words end in a suffix and which
    has no truncation, padding or unknown token; any other file raises ``ValueError``.
    """

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        split = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        if not (model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
                and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
                and len(split) == 2 and split[0].get("pattern") == {"Regex": PATTERN} and split[0].get("invert")
                and split[0].get("behavior") == "Removed" and split[1].get("type") == "ByteLevel"
                and not split[1].get("use_regex") and not split[1].get("add_prefix_space")):
            raise ValueError("not a byte-level BPE with word ends and the pattern this splitter is compiled from")
        d["truncation"] = d["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(d))
        kinds = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        self.plain_normal = kinds == ["NFC", "Replace", "Lowercase"]
        added = d.get("added_tokens") or []
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError("added tokens that depend on their surroundings")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.counter = Counter(model)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    # ------------------------------------------------------------ characters
    def _normal(self, text: str) -> str:
        """The normalizer's result, but for white space, of which none counts."""
        if self.plain_normal:
            if text.isascii():
                return text.lower()
            # as the library lower-cases: character by character, so also a final sigma
            if _COMMON.fullmatch(text):
                return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _class_of(self, code: int) -> int:
        c = chr(code)
        if c == "'":
            return _QUOTE
        if c in "stmd":
            return _ONE
        if c in "rvle":
            return {"r": _R, "v": _V, "l": _L, "e": _E}[c]
        if 0xD800 <= code < 0xE000:
            return _MARK
        found = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a"))
        return {1: _LETTER, 2: _SPACE, 3: _MARK, 4: _NUMBER}[found]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = _classes[codes]
        if (out == 255).any():
            for code in np.unique(codes[out == 255]).tolist():
                _classes[code] = self._class_of(code)
            out = _classes[codes]
        return out

    # ----------------------------------------------------------------- parts
    def _segments(self, texts: list[str]) -> Iterator[tuple[int, str | None, bool]]:
        """(text, part, whether the next part goes on with it); a special token is the part None."""
        for i, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                yield from self._parts(i, text, at, m.start())
                yield i, None, False
                at = m.end()
            yield from self._parts(i, text, at, len(text))

    @staticmethod
    def _parts(i: int, text: str, at: int, end: int) -> Iterator[tuple[int, str, bool]]:
        """Parts of PART characters that end before a character that neither composes with the one before nor ends a short form."""
        while end - at > PART:
            m = _CUT.search(text, at + PART, end)
            if m is None:
                break
            yield i, text[at : m.start()], True
            at = m.start()
        if end > at:
            yield i, text[at:end], False

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        kept: list[tuple[int, str]] = []
        size, carried = 0, None
        for i, part, goes_on in self._segments(texts):
            if part is None:
                total[i] += 1
                continue
            part = self._normal(part)
            if goes_on or carried is not None:
                carried = self._long(total, i, part, carried, goes_on)
                continue
            kept.append((i, part))
            size += len(part) + 1
            if size > PART:
                self._short(total, kept)
                kept, size = [], 0
        if kept:
            self._short(total, kept)
        return total

    def _short(self, total: np.ndarray, kept: list[tuple[int, str]]) -> None:
        """Adds the counts of whole segments, read as one text with spaces between them."""
        codes = _codes(" ".join(x for _, x in kept))
        classes = self.classes(codes)
        starts, ends, raw = self._pieces(codes, classes, scan_states(classes, _NONE))
        own = self._counts(raw, starts[1], ends[1])
        edges = np.cumsum([len(x) + 1 for _, x in kept])
        np.add.at(total, np.array([i for i, _ in kept])[np.searchsorted(edges, starts[0], side="right")], own)

    def _long(self, total: np.ndarray, i: int, part: str, carried: tuple | None, goes_on: bool) -> tuple | None:
        """Adds the counts of the pieces that end in a part; returns (splitter's state, counter's state, count, end) if it goes on."""
        state, at, count, end = carried or (_NONE, 0, 0, 0)
        codes = _codes(part)
        if not len(codes):
            return (state, at, count, end) if goes_on else self._closed(total, i, state, end)
        classes = self.classes(codes)
        states = scan_states(classes, state)
        starts, ends, raw = self._pieces(codes, classes, states)
        if state != _NONE:  # the carried piece goes on up to the first piece or space
            first = np.flatnonzero(piece_starts(classes, states) | (classes == _SPACE))
            upto = int(first[0]) if len(first) else len(codes)
            if upto:
                width = int(_widths(codes[:upto]).sum())
                at, count, end = self.counter.run(raw[:width].tobytes(), at, count)
            if upto == len(codes) and goes_on:
                return int(states[-1]), at, count, end
            self._closed(total, i, state, end)
        pairs = starts[1], ends[1]
        open_last = goes_on and states[-1] != _NONE and len(pairs[0])
        if open_last:
            at, count, end = self.counter.run(raw[pairs[0][-1] : pairs[1][-1]].tobytes())
            pairs = pairs[0][:-1], pairs[1][:-1]
        total[i] += int(self._counts(raw, *pairs).sum())
        if goes_on:
            return (int(states[-1]), at, count, end) if open_last else (_NONE, 0, 0, 0)
        return None

    @staticmethod
    def _closed(total: np.ndarray, i: int, state: int, end: int) -> None:
        if state != _NONE:
            total[i] += end

    @staticmethod
    def _pieces(codes: np.ndarray, classes: np.ndarray, states: np.ndarray) -> tuple:
        """Pieces' beginnings and ends, in characters and in bytes, and the bytes."""
        start = piece_starts(classes, states)
        border = np.append(np.flatnonzero(start | (classes == _SPACE)), len(codes))
        mine = np.flatnonzero(start[border[:-1]])
        first, last = border[mine], border[mine + 1]
        upto = np.concatenate([[0], np.cumsum(_widths(codes))])
        raw = np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return (first, upto[first]), (last, upto[last]), raw

    def _counts(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Token counts of pieces of ``raw``; new pieces go through the transducer."""
        if not len(first):
            return np.zeros(0, np.int64)
        distinct, at, back = np.unique(_span_hashes(raw, first, last), return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.known):
            known = self.known[np.minimum(where, len(self.known) - 1)] == distinct
        counts = np.zeros(len(distinct), np.int64)
        counts[known] = self.counts[where[known]]
        if not known.all():
            self.counter.tidy_up()
            new = at[~known]
            text = raw.tobytes()
            run = self.counter.run
            counts[~known] = [run(text[a:b])[2] for a, b in zip(first[new].tolist(), last[new].tolist())]
            if len(self.known) + len(new) > MOST_PIECES:
                self._forget()
                where = np.zeros(len(distinct), np.int64)
            self.known = np.insert(self.known, where[~known], distinct[~known])
            self.counts = np.insert(self.counts, where[~known], counts[~known])
        return counts[back]


#: Texts whose normal form is the same in every version of Unicode since long: no character of the
#: supplementary planes but emoji, nor of the blocks that grew in recent versions.
_COMMON = regex.compile("[\u0000-ԯḀ-↏←-⯿　-ヿ一-龥가-힣\U0001f300-\U0001f5ff]*")
#: A place to end a part: before a letter, number or space (no conjoining jamo), no apostrophe just before it.
_CUT = regex.compile("(?<!'.{0,2})(?=[\\p{L}\\p{N}\\s])(?![ᅠ-ᇿힰ-퟿])", regex.DOTALL)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _widths(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    up, down = _powers(1 << (max(len(raw), 1) - 1).bit_length())
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


@functools.lru_cache(maxsize=2)
def compiled(spec: str) -> TokenCounter:
    """The transducers of a tokenizer file's content, kept by the Python worker."""
    return TokenCounter(spec)


def _count_map(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(shared.value)
        for batch in parts(batches, 512):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counter.count(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): the UTF-8 bytes and the tokens of every whole text.

    Counts are those of the tokenizers library without begin, end or other added tokens; the special
    strings of the file inside a text are one token each, as by the library's default.  Null texts are empty
    (0 and 0).  Each row gives a row, repeated or not, with or without a doc_id; other columns are
    not read; an empty table gives no rows.  The tokenizer file is read on the driver and
    broadcast (a few MB).
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    compiled(spec)  # refuses files of another kind before any task starts
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidy(_count_map(shared)), "doc_id long, n_bytes long, n_tokens long")
