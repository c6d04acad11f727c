"""SentencePiece BPE by a prefix table.

Every prefix of a text has one last token in its BPE encoding. A vocabulary
token that ends where the prefix does is that token if it is compatible with the last
token of what stands before it: the two, encoded together, stay those two. An automaton
finds the tokens that end at each place; compatibility is tested once
for each pair of tokens and remembered. The ids are recovered backwards.

No token goes on behind a blank, so that words can be taken apart. A batch's distinct
words step through the automaton together, one character of each at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "▁"
#: Words kept before the memo starts anew; the longest word that steps with others; words that step together; texts and characters taken at once.
MEMO, WORD_CHARS, TOGETHER, TEXTS, CHARS = 800_000, 40, 1 << 14, 1000, 1 << 25


def default_path() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start..start + count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Numbers:
    """A map of whole numbers that looks up many at once; -1 stands for none."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.first(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        going = np.flatnonzero((held != keys) & (held >= 0))
        while len(going):
            at[going] = (at[going] + 1) & (len(self.keys) - 1)
            held = self.keys[at[going]]
            hit = held == keys[going]
            out[going[hit]] = self.values[at[going[hit]]]
            going = going[~hit & (held >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes keys that are new and differ."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            there = self.keys >= 0
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.__init__(max(self.bits, int(2 * len(keys)).bit_length() + 1))
            self.n = len(keys)
        at = self.first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)


class PrefixTable:
    """Encodes exactly as the library does with a merge-type model with byte fallback.

    Tokens have numbers: 0 stands for none, ``other`` and a code point for a character that is no token.
    """

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = ["", *(sp.id_to_piece(i) for i in plain)]
        self.other = len(self.text)
        self.number = {t: k for k, t in enumerate(self.text)}
        self.id = np.array([-1, *plain], np.int32)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.text)
        self._automaton()
        self.pairs = Numbers(20)
        self.scalar_pairs: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # what an id of a token gives in a decoded text; other ids are left to the library
        self.shown = [""] * sp.get_piece_size()
        for k, i in enumerate(plain, 1):
            self.shown[i] = self.text[k].replace(BLANK, " ")
        self.simple = np.zeros(sp.get_piece_size(), bool)
        self.simple[[*plain, *(i for i in [sp.eos_id()] if i >= 0)]] = True

    def _automaton(self) -> None:
        """Moves by (state, character), the state to go on from where there is none, the longest token that ends in a state, and the next shorter one of each token."""
        letters = sorted({c for piece in self.text for c in piece})
        code = {c: k + 1 for k, c in enumerate(letters)}
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.move: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = [[]]
        ends, state_of = [0], [0] * len(self.text)
        for k, piece in enumerate(self.text[1:], 1):
            s = 0
            for depth, c in enumerate(piece):
                key = s << 20 | code[c]
                t = self.move.get(key)
                if t is None:
                    t = self.move[key] = len(ends)
                    ends.append(0)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((s, code[c], t))
                s = t
            ends[s], state_of[k] = k, s
        fail, longest = [0] * len(ends), ends
        for depth, level in enumerate(levels):
            for s, c, t in level:
                f = fail[s]
                while f and f << 20 | c not in self.move:
                    f = fail[f]
                fail[t] = self.move.get(f << 20 | c, 0) if depth else 0
        shorter = [0] * len(self.text)
        for level in levels:
            for _, _, t in level:
                if longest[t]:
                    shorter[longest[t]] = longest[fail[t]]
                else:
                    longest[t] = longest[fail[t]]
        self.moves = Numbers(20)
        self.moves.add(np.fromiter(self.move, np.int64, len(self.move)), np.fromiter(self.move.values(), np.int32, len(self.move)))
        self.fail, self.longest, self.shorter = np.array(fail, np.int64), np.array(longest, np.int64), np.array(shorter, np.int64)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.lists = fail, longest, shorter, [len(t) for t in self.text]

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored merge first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                score = self.score.get(pair[0] + pair[1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay(self, before: int, token: int) -> bool:
        """Whether the two stay as they are when encoded together; before is 0 at the start and behind a character that is no token."""
        a, b = self.text[before], self.text[token]
        return self.merged(a + b) == ([a, b] if a else [b])

    def compatible(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``stay`` of many pairs, remembered."""
        keys = np.where(before < self.other, before, 0) << 24 | token
        found = self.pairs.get(keys)
        if (found < 0).any():
            fresh = np.unique(keys[found < 0])
            if self.pairs.n > 4 * MEMO:
                self.pairs = Numbers(20)
                fresh = np.unique(keys)
            self.pairs.add(fresh, np.array([self.stay(k >> 24, k & 0xFFFFFF) for k in fresh.tolist()], np.int32))
            found = self.pairs.get(keys)
        return found > 0

    def step_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words, each with a blank in front: all of them one after another, and the number of each. ``words`` are in falling order of length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, wide = len(words), int(lengths[0]) + 1
        points = np.full((n, wide), ord(BLANK), np.int64)
        points[:, 1:][np.arange(wide - 1) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.ascontiguousarray(self.code[points].T)
        last = np.zeros((wide + 1, n), np.int64)
        state = np.zeros(n, np.int64)
        for at in range(wide):
            active = int(np.searchsorted(-lengths, -at, side="right"))
            c, s = codes[at, :active], state[:active]
            to = self.moves.get(s << 20 | c).astype(np.int64)
            going = np.flatnonzero((to < 0) & (s > 0))
            while len(going):
                s[going] = self.fail[s[going]]
                to[going] = self.moves.get(s[going] << 20 | c[going])
                going = going[(to[going] < 0) & (s[going] > 0)]
            state[:active] = to = np.maximum(to, 0)
            rows, token = np.arange(active), self.longest[to]
            last[at + 1, :active] = self.other + points[:active, at]
            while True:
                some = token > 0
                rows, token = rows[some], token[some]
                if not len(rows):
                    break
                fits = self.compatible(last[at + 1 - self.size[token], rows], token)
                last[at + 1, rows[fits]] = token[fits]
                rows, token = rows[~fits], self.shorter[token[~fits]]
        # backwards from each end; the last token of a word comes first
        place, rows, steps = lengths + 1, np.arange(n), []
        while len(rows):
            token = last[place, rows]
            steps.append((rows, token))
            place = place - np.where(token < self.other, self.size[np.minimum(token, self.other - 1)], 1)
            rows, place = rows[place > 0], place[place > 0]
        rows, tokens = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(rows, kind="stable")
        return self.ids_of(tokens[order], rows[order], n)

    def ids_of(self, tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of token numbers, where a character that is no token has one for each of its bytes, and how many each row has."""
        strange = tokens >= self.other
        if not strange.any():
            return self.id[tokens], np.bincount(rows, minlength=n)
        points = tokens[strange] - self.other
        counts = np.ones(len(tokens), np.int64)
        counts[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.repeat(self.id[np.where(strange, 0, tokens)], counts)
        spelt = "".join(map(chr, points.tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat(strange, counts)] = self.bytes[np.frombuffer(spelt, np.uint8)]
        return out, np.bincount(rows, counts, n).astype(np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """The ids of a text of any length, one character after another."""
        fail, longest, shorter, size = self.lists
        move, pairs, other = self.move, self.scalar_pairs, self.other
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        last, s, end = [0] * (len(points) + 1), 0, 0
        for c in self.code[points].tolist():
            end += 1
            t = move.get(s << 20 | c)
            while t is None and s:
                s = fail[s]
                t = move.get(s << 20 | c)
            s = t or 0
            token = longest[s]
            while token:
                before = last[end - size[token]]
                key = (before if before < other else 0) << 24 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= MEMO:
                        pairs.clear()
                    fits = pairs[key] = self.stay(key >> 24, token)
                if fits:
                    break
                token = shorter[token]
            last[end] = token or other + int(points[end - 1])
        out = []
        while end:
            token = last[end]
            out.append(token)
            end -= size[token] if token < other else 1
        out.reverse()
        return self.ids_of(np.array(out, np.int64), np.zeros(len(out), np.int64), 1)[0]

    def learn(self, words: list[str]) -> None:
        """Takes up words that are not known yet."""
        words = sorted(words, key=len, reverse=True)
        found = [self.step_words(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        sizes = np.concatenate([self.sizes, *(s for _, s in found)])
        self.words.update(zip(words, range(len(self.sizes), len(sizes)), strict=True))
        self.flat, self.sizes, self.starts = np.concatenate([self.flat, *(i for i, _ in found)]), sizes, np.cumsum(sizes) - sizes

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalized texts that begin with a blank and have none beside another: all, and the number of each text."""
        split = pc.split_pattern(pa.array([t[1:] for t in texts], pa.large_string()), BLANK)
        coded = split.values.dictionary_encode()
        distinct, turn = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.words) + len(distinct) > MEMO:
            self.words.clear()
            self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        fresh = [w for w in distinct if w not in self.words and len(w) < WORD_CHARS]
        if fresh:
            self.learn(fresh)
        place = np.fromiter((self.words.get(w, -1) for w in distinct), np.int64, len(distinct))
        long = np.flatnonzero(place < 0)
        starts, sizes, flat = self.starts, self.sizes, self.flat
        if len(long):
            more = [self.prefixes(BLANK + distinct[k]) for k in long.tolist()]
            place[long] = len(sizes) + np.arange(len(long))
            sizes = np.concatenate([sizes, [len(x) for x in more]])
            starts, flat = np.cumsum(sizes) - sizes, np.concatenate([flat, *more])
        at = place[turn]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[split.offsets.to_numpy()]
        return flat[_ranges(starts[at], sizes[at])], np.diff(ends)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each."""
        out, counts, at = [], [], 0
        while at < len(texts):
            some, chars = [], 0
            while at < len(texts) and len(some) < TEXTS and chars < CHARS:
                some.append(self.library.normalize(texts[at]))
                chars += len(some[-1])
                at += 1
            plain = np.array([self.cuts and t.startswith(BLANK) and BLANK * 2 not in t for t in some])
            got = np.zeros(len(some), np.int64)
            if plain.all():
                ids, got = self.encode_words(some)
                out.append(ids)
            else:
                ids, got[plain] = self.encode_words([t for t, p in zip(some, plain, strict=True) if p]) if plain.any() else (np.zeros(0, np.int32), [])
                parts = iter(np.split(ids, np.cumsum(got[plain])[:-1]))
                for k, t in enumerate(some):
                    if plain[k]:
                        out.append(next(parts))
                        continue
                    pieces = re.findall(f"{BLANK}+[^{BLANK}]*|^[^{BLANK}]+", t) if self.cuts else [t] * bool(t)
                    ids = [self.prefixes(p) for p in pieces]
                    got[k] = sum(map(len, ids))
                    out += ids
            counts.append(got)
        return (np.concatenate(out), np.concatenate(counts)) if texts and out else (np.zeros(0, np.int32), np.zeros(len(texts), np.int64))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """What the library's decode gives for each row of ids; rows of tokens alone are put together here."""
        offsets = np.concatenate([[0], np.cumsum(counts)])
        known = (ids >= 0) & (ids < len(self.simple))
        strange = np.concatenate([[0], np.cumsum(~(known & self.simple[np.where(known, ids, 0)]))])
        hard = (np.diff(strange[offsets]) > 0).tolist()
        offsets, ids, out = offsets.tolist(), ids.tolist(), []
        for odd, low, high in zip(hard, offsets, offsets[1:], strict=False):
            text = None if odd else "".join(map(self.shown.__getitem__, ids[low:high]))
            # one blank in front is none of the text's; the library knows what more of them mean
            out.append(self.library.decode(ids[low:high]) if odd or text == " " or text.startswith("  ") else text.removeprefix(" "))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PrefixTable:
    """One for each Python worker."""
    return PrefixTable(path)


def encode(text: Column, path: str | None = None, end: bool = True) -> Column:
    """array<int> of ids, with the end id after them if ``end``.

    Null counts as empty: the end id alone. A text of any length is read whole; repeated
    rows each get their ids, and a table without rows none.
    """
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        table = load(path)
        ids, counts = table.encode_all([t or "" for t in texts.to_pylist()])
        ends = np.cumsum(counts)
        if end:
            ids = np.insert(ids, ends, table.library.eos_id())
            ends = ends + np.arange(1, len(ends) + 1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))

    return of(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text that the library's decode gives for an array of ids; null stays null, no ids give an empty text."""
    path = path or default_path()

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        values, counts = rows.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        texts = load(path).decode_all(values.astype(np.int64), counts.astype(np.int64))
        return pa.array([t if there else None for t, there in zip(texts, rows.is_valid().to_pylist(), strict=True)], pa.string())

    return of(ids)
