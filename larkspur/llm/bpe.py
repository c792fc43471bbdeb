"""Byte-pair vocabularies and the per-prefix dynamic program that encodes with them.

A piece (pre-token) is a string with one character per byte; where a vocabulary marks word ends, the last
character carries END. Ranks are the order of the merges.

The dynamic program stores for each prefix of a piece the last token of the prefix's encoding. A matching
automaton names the tokens that end at a position; of these exactly one goes together with the last token of what
lies before it, which compatible() tests on the pair alone. Back-pointers then give the ids. Time is linear in the
piece, so very long pieces are encoded whole.
"""

from __future__ import annotations

import json
import sys
from collections import deque

#: Added to the code of a character that ends a word.
END = 256
_NEVER = 1 << 60


def _byte_chars() -> dict[str, str]:
    """Characters that byte-level vocabulary files print for bytes: printable Latin-1 stands for itself, the other bytes follow from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Vocabulary:
    """The strings, ids and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, chars = file["model"], _byte_chars()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}

        def plain(shown: str) -> str:
            if self.suffix and shown.endswith(self.suffix):
                body = "".join(chars[c] for c in shown[: -len(self.suffix)])
                return body[:-1] + chr(ord(body[-1]) + END)
            return "".join(chars[c] for c in shown)

        self.ids = {plain(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        size = max(self.ids.values()) + 1
        self.made = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.strings = [""] * size
        for s, i in self.ids.items():
            self.strings[i] = s
        for rank, merge in enumerate(model["merges"]):
            a, b = (plain(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[left, right] = rank, whole
            self.made[whole], self.halves[whole] = rank, (left, right)
        self._memo: dict[int, bool] = {}
        self.whole = self._prove_whole()

    def _agree(self, a: int, b: int, spent: int) -> bool:
        """Whether the merges keep tokens a and b apart, up to the merge of rank spent.

        Undoes the younger of the tokens at the border, again and again. Two neighbours at the border would have merged if
        their merge comes before the one that used up either of them. Merges of one rank run from the left, so of equal ranks
        the left token is used up first and the right one last.
        """
        merges, made, halves = self.merges, self.made, self.halves
        used_a = used_b = spent
        while True:
            found = merges.get((a, b))
            if found is not None and found[0] < used_a and found[0] <= used_b:
                return False
            if made[a] > made[b]:
                used_a = made[a]
                a = halves[a][1]
            elif made[b] >= 0:
                used_b = made[b]
                b = halves[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self._memo.get(key)
        if found is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            found = self._memo[key] = self._agree(a, b, _NEVER)
        return found

    def _prove_whole(self) -> set[int]:
        """Ids of the strings that encode, alone, as one token: single characters, and those whose halves are such strings
        and stay apart up to the last merge. A rank runs from the left, so the last merge itself is no conflict."""
        whole = {i for s, i in self.ids.items() if len(s) == 1}
        for (a, b), (rank, i) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            if a in whole and b in whole and self.halves[i] == (a, b) and self._agree_below(a, b, rank):
                whole.add(i)
        return whole

    def _agree_below(self, a: int, b: int, rank: int) -> bool:
        found = self.merges.pop((a, b))
        try:
            return self._agree(a, b, rank)
        finally:
            self.merges[a, b] = found

    def merge(self, piece: str) -> list[int]:
        """Ids of a short piece by the merges themselves: the lowest rank first, from the left."""
        ids = [self.ids[c] for c in piece]
        merges = self.merges
        while len(ids) > 1:
            best = min([merges.get(pair, _LAST) for pair in zip(ids, ids[1:])])
            if best is _LAST:
                break
            new, (left, right) = best[1], self.halves[best[1]]
            i, out, n = 0, [], len(ids)
            while i < n:
                if ids[i] == left and i + 1 < n and ids[i + 1] == right:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


_LAST = (_NEVER, -1)


class PrefixEncoder:
    """The per-prefix dynamic program over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._build([vocabulary.strings[i] for i in vocabulary.whole], list(vocabulary.whole))

    def _build(self, strings: list[str], ids: list[int]) -> None:
        step: dict[int, int] = {}
        depth_of, here, kids = [0], [None], [[]]
        for s, i in zip(strings, ids):
            state = 0
            for c in s:
                key = state << 10 | ord(c)
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(here)
                    here.append(None)
                    kids.append([])
                    kids[state].append((ord(c), nxt))
                state = nxt
            here[state] = (i, len(s))
        fail, ends = [0] * len(here), [()] * len(here)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for c, nxt in kids[state]:
                if state:
                    back = fail[state]
                    while (key := back << 10 | c) not in step and back:
                        back = fail[back]
                    fail[nxt] = step.get(key, 0)
                ends[nxt] = ((here[nxt],) if here[nxt] else ()) + ends[fail[nxt]]
                todo.append(nxt)
        self._step, self._fail, self._ends = step, fail, ends

    def _go(self, state: int, c: int) -> int:
        """The automaton's step; steps over failure links are kept."""
        key, step = state << 10 | c, self._step
        back = state
        while (at := back << 10 | c) not in step and back:
            back = self._fail[back]
        found = step.get(at, 0)
        if len(step) < 2_000_000:
            step[key] = found
        return found

    def encode(self, piece: str) -> list[int]:
        last, size, state = [], [], 0
        step, ends, memo, compatible = self._step, self._ends, self.v._memo, self.v.compatible
        i = 0
        for c in piece:
            c = ord(c)
            nxt = step.get(state << 10 | c)
            state = self._go(state, c) if nxt is None else nxt
            i += 1
            for token, n in ends[state]:
                if n == i:
                    break
                before = last[i - n - 1]
                ok = memo.get(before << 20 | token)
                if compatible(before, token) if ok is None else ok:
                    break
            else:
                raise ValueError("a character that the vocabulary lacks")
            last.append(token)
            size.append(n)
        out = []
        while i:
            out.append(last[i - 1])
            i -= size[i - 1]
        out.reverse()
        return out


class Bounded(dict):
    """A memo that computes what it lacks; of all it has computed, it keeps the last two generations."""

    def __init__(self, compute, fixed: dict | None = None, most: int = 300_000):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.most, self.old = compute, fixed or {}, most + len(fixed or {}), {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        if len(key) <= 64:
            self[key] = found
        return found


def newer_characters() -> tuple[set[str], dict[str, set[str]]]:
    """Characters that the tokenizers library's Unicode tables have and Python's lack, and which of these are letters (L) and numbers (N).

    The library is asked for its tables, whatever versions of either are installed.
    """
    import unicodedata

    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")

    def among(pattern: str) -> set[str]:
        return set("".join(piece for piece, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(unknown)))

    return among(r"\P{Cn}+"), {"L": among(r"\p{L}+"), "N": among(r"\p{N}+")}


def letter_class(more: dict[str, set[str]] | None = None) -> tuple[str, str]:
    """Bodies of character classes for letters and numbers, from the Unicode categories and the characters in more."""
    import unicodedata

    more = {c: kind for kind, chars in (more or {}).items() for c in chars}
    found = {"L": [], "N": []}
    for code in range(sys.maxunicode + 1):
        kind = more.get(chr(code)) or unicodedata.category(chr(code))[0]
        if kind in found:
            spans = found[kind]
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return tuple("".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")


#: Characters that are white space to the tokenizers' patterns (Unicode White_Space).
SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
