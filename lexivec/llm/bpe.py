"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token: the vocabulary entry t that is a suffix of the prefix, encodes to
itself, and stands next to the last token u of what precedes it such that u + t encodes to (u, t). So one pass over a
word gives, for every prefix, the last token and the token count, and the encoding is read off backwards. The states of
a shared prefix are the same in every word, which lets words be walked as a trie.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: The words of a tokenizer whose merges carry an end-of-word mark have their last symbol moved up by this.
LAST = 0x2000
#: Code points from here on may be of other classes to the tokenizer library than to `regex`.
FAR = re.compile("[\u0530-\U0010ffff]")


class LastTokenStates:
    """vocab: symbol string -> id; ranks: (left, right) -> merge rank. Ids lie below START."""

    #: Pairs remembered; beyond that the memory is emptied.
    MOST_PAIRS = 300_000
    #: Stands before the first token.
    START = 1 << 20

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int]):
        import ahocorasick

        self.vocab, self.ranks = vocab, ranks
        self.token = {i: t for t, i in vocab.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in vocab.values()}
        self.ends = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.ends.add_word(token, (i, len(token)))
        self.ends.make_automaton()
        made = {a + b: r for (a, b), r in reversed(ranks.items())}
        #: Whether every pair is ranked after what it joins, as in any trained vocabulary; then spines tell all.
        self.ordered = all(made.get(x, -1) < r for (a, b), r in ranks.items() for x in (a, b))
        self._pairs: dict[int, bool] = {}
        self._spines: dict[int, tuple[list, list, bool]] = {}

    def merge(self, symbols: str, seen=None) -> list[str]:
        """Plain BPE of a short string; seen(parts, rank) is told the parts before each merge."""
        parts, ranks = list(symbols), self.ranks
        while len(parts) > 1:
            found = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := ranks.get(pair)) is not None]
            if not found:
                break
            rank, at = min(found)
            left, right = parts[at], parts[at + 1]
            if seen:
                seen(parts, rank)
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spines(self, token: int) -> tuple[list, list, bool]:
        """The parts that stand at a token's left and right edge while it is merged, each with the rank of the merge that
        ends it, and whether the token encodes to itself."""
        known = self._spines.get(token)
        if known is None:
            text, left, right, never = self.token[token], [], [], len(self.ranks)
            steps: list[tuple[str, str, int]] = []
            whole = self.merge(text, lambda parts, rank: steps.append((parts[0], parts[-1], rank)))
            steps.append((whole[0], whole[-1], never))
            for (a, b, rank), (c, d, _) in zip(steps, [*steps[1:], ("", "", 0)]):
                if c != a:
                    left.append((a, rank))
                if d != b:
                    right.append((b, rank))
            known = self._spines[token] = (left, right, whole == [text])
        return known

    def judge(self, left: int, right: int) -> bool:
        """Can `right` follow `left`? Only if no merge ever reaches over the edge between them: of two parts at the edge
        the pair must not come up before either is merged away on its own side (of equal ranks the left one goes first)."""
        starts, _, alone = self.spines(right)
        if not alone or left == self.START:
            return alone
        if not self.ordered:
            return self.merge(self.token[left] + self.token[right]) == [self.token[left], self.token[right]]
        ranks = self.ranks
        for x, x_ends in self.spines(left)[1]:
            for y, y_ends in starts:
                r = ranks.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def extend(self, word: str, last: list[int], count: list[int]) -> None:
        """last[i] and count[i] hold the states of word[:i]; append those of the longer prefixes up to the whole word."""
        pairs, done = self._pairs, len(last) - 1
        if len(pairs) > self.MOST_PAIRS:
            pairs.clear()
        for end, (token, length) in self.ends.iter(word):
            if end != done:
                if end > done:
                    break
                continue
            j = end + 1 - length
            key = last[j] << 21 | token
            known = pairs.get(key)
            if known is None:
                known = pairs[key] = self.judge(last[j], token)
            if known:
                last.append(token)
                count.append(count[j] + 1)
                done += 1
        if done != len(word):
            raise ValueError(f"no token ends at {done} of {word!r}: the vocabulary lacks a symbol")

    def counts(self, word: str) -> list[int]:
        """The token count of every prefix of a word, the empty one first."""
        last, count = [self.START], [0]
        self.extend(word, last, count)
        return count

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Encode distinct words, in any order, to ids as little-endian unsigned 32-bit integers: a depth-first walk over
        their trie, so that the states of a prefix that several words share are computed once. Sorted words visit the
        trie's leaves depth first; what the next word shares with the last one is the part of the path that stays. As
        extend(), but each state carries its prefix's ids."""
        out = [b""] * len(words)
        last, ids, before, pairs, judge = [self.START], [b""], "", self._pairs, self.judge
        matches, packed = self.ends.iter, self.packed
        for k in sorted(range(len(words)), key=words.__getitem__):
            word, done, most = words[k], 0, min(len(before), len(words[k]))
            while done < most and before[done] == word[done]:
                done += 1
            del last[done + 1 :], ids[done + 1 :]
            if len(pairs) > self.MOST_PAIRS:
                pairs.clear()
            for end, (token, length) in matches(word):
                if end != done:
                    if end > done:
                        break
                    continue
                j = end + 1 - length
                left = last[j]
                known = pairs.get(key := left << 21 | token)
                if known is None:
                    known = pairs[key] = judge(left, token)
                if known:
                    last.append(token)
                    ids.append(ids[j] + packed[token])
                    done += 1
            if done != len(word):
                raise ValueError(f"no token ends at {done} of {word!r}: the vocabulary lacks a symbol")
            out[k], before = ids[-1], word
        return out


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


@lru_cache(maxsize=4)
def load(path: str) -> tuple[LastTokenStates, dict[str, int], list[tuple[str, int]]]:
    """From a tokenizer's JSON file: its states, the id of each symbol string and the added tokens."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, mark = said["model"], said["model"].get("end_of_word_suffix") or ""

    def packed(token: str) -> str:
        if mark and token.endswith(mark) and len(token) > len(mark):
            token = token[: -len(mark)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    vocab = {packed(t): i for t, i in model["vocab"].items()}
    ranks: dict[tuple[str, str], int] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault((packed(left), packed(right)), rank)
    return LastTokenStates(vocab, ranks), vocab, [(a["content"], a["id"]) for a in said.get("added_tokens", [])]


def unpacked(token: str, mark: str = "</w>") -> str:
    return token[:-1] + chr(ord(token[-1]) - LAST) + mark if ord(token[-1]) >= LAST else token


class Classes:
    r"""Letters and digits as the tokenizer library sees them. Its Unicode tables and those of `regex` differ in a few
    thousand rare code points; text that has one is matched through a stand-in of the right class, of the same length."""

    LETTER, DIGIT, OTHER = "a", "0", "!"

    def __init__(self) -> None:
        self._odd: dict[int, str] | None = None

    def odd(self) -> dict[int, str]:
        if self._odd is None:
            import regex
            from tokenizers import Regex, pre_tokenizers

            every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
            theirs, ours = {}, {}
            for name, pattern in ((self.LETTER, r"\p{L}"), (self.DIGIT, r"\p{N}")):
                outside = pre_tokenizers.Split(Regex(pattern + "+"), "removed").pre_tokenize_str(every)
                rest = {c for piece, _ in outside for c in piece}
                theirs |= {c: name for c in every if c not in rest}
                ours |= {c: name for c in regex.findall(pattern, every)}
            self._odd = {ord(c): theirs.get(c, self.OTHER) for c in every if theirs.get(c) != ours.get(c)}
        return self._odd

    def stand_in(self, text: str) -> str:
        if text.isascii() or not FAR.search(text):
            return text
        return text.translate(self.odd())


CLASSES = Classes()


class Memory(dict):
    """chunk -> what `fill` makes of it; the entries of two generations are kept, `most` each, so memory is bounded."""

    def __init__(self, fill, most: int = 250_000):
        super().__init__()
        self.fill, self.most, self.old = fill, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.fill(key)
        self[key] = found
        return found

    def turn(self) -> None:
        """Call between batches."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
