"""A minimal acyclic transducer from words to sequences of ids, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np

from boardlens.llm.hashing import Lookup


class Transducer:
    """Words (bytes) with output ids. Words with equal suffixes share states, and every arc carries how many words
    lie before those that go through it: the sum along a word is its number, which selects its ids.
    """

    FIELDS = ("final", "keys", "values", "full", "skips", "targets", "bounds", "ids")

    def __init__(self, arrays: dict[str, np.ndarray], shift: int, most: int):
        self.arrays = arrays
        self.__dict__ |= arrays
        self.arcs = Lookup.__new__(Lookup)
        self.arcs.shift, self.arcs.most = np.uint64(shift), most
        self.arcs.keys, self.arcs.values, self.arcs.full = arrays["keys"], arrays["values"], arrays["full"]

    @classmethod
    def build(cls, words: list[bytes], ids: list[bytes]) -> Transducer:
        """Sorted-order construction: states of a finished suffix are replaced by equal ones that exist already."""
        order = sorted(range(len(words)), key=words.__getitem__)
        children: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) along the last word
        last = b""

        def settle(depth: int) -> None:
            while len(path) > depth:
                state, byte = path.pop()
                child = children[state][byte]
                key = (final[child], tuple(children[child].items()))
                if (same := register.setdefault(key, child)) != child:
                    children[state][byte] = same

        for k in order:
            word = words[k]
            common = len(os.path.commonprefix([word, last]))
            settle(common)
            state = children[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                children.append({})
                final.append(False)
                children[state][byte] = len(children) - 1
                path.append((state, byte))
                state = len(children) - 1
            final[state] = True
            last = word
        settle(0)
        # Words below each state, children first; then the live states get new numbers.
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            state, ready = stack.pop()
            if state in below:
                continue
            if ready:
                below[state] = final[state] + sum(below[c] for c in children[state].values())
            else:
                stack.append((state, True))
                stack += [(c, False) for c in children[state].values() if c not in below]
        number = {s: i for i, s in enumerate(sorted(below))}
        keys, skips, targets = [], [], []
        for s in sorted(below):
            before = int(final[s])
            for byte in sorted(children[s]):
                keys.append(number[s] << 8 | byte)
                skips.append(before)
                targets.append(number[children[s][byte]])
                before += below[children[s][byte]]
        arcs = Lookup(np.array(keys, np.uint64), np.arange(len(keys)))
        out = [ids[k] for k in order]
        arrays = {
            "final": np.array([final[s] for s in sorted(below)], bool),
            "keys": arcs.keys,
            "values": arcs.values,
            "full": arcs.full,
            "skips": np.array(skips, np.int64),
            "targets": np.array(targets, np.int64),
            "bounds": np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64),
            "ids": np.frombuffer(b"".join(out), "<u4"),
        }
        return cls(arrays, int(arcs.shift), arcs.most)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in sorted order, -1 for other words. All words go through the automaton in step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            arc = self.arcs(state[live].astype(np.uint64) << np.uint64(8) | data[at[live] + step], -1)
            state[live[arc < 0]] = -1
            live, arc = live[arc >= 0], arc[arc >= 0]
            total[live] += self.skips[arc]
            state[live] = self.targets[arc]
            step += 1
            live = live[size[live] > step]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] if len(self.final) else False
        return np.where(ok, total, -1)

    def outputs(self, numbers: np.ndarray) -> list[bytes]:
        """The ids of words by number, as little-endian 32-bit integers."""
        data = memoryview(self.ids).cast("B")
        return [bytes(data[4 * i : 4 * j]) for i, j in zip(self.bounds[numbers].tolist(), self.bounds[numbers + 1].tolist(), strict=True)]

    def to_bytes(self) -> tuple[bytes, list]:
        """(the arrays one after the other, what mapped() needs to find them)."""
        at, layout, parts = 0, [], []
        for name in self.FIELDS:
            x = np.ascontiguousarray(self.arrays[name])
            pad = -at % 8
            layout.append((name, str(x.dtype), len(x), at + pad))
            parts += [bytes(pad), x.tobytes()]
            at += pad + x.nbytes
        return b"".join(parts), [layout, int(self.arcs.shift), self.arcs.most]

    @classmethod
    def mapped(cls, data: bytes, about: list) -> Transducer:
        """The automaton on a memory-mapped file of this process; the file's name goes at once, so nothing stays behind."""
        layout, shift, most = about
        handle, path = tempfile.mkstemp(suffix=".transducer")
        with os.fdopen(handle, "wb") as f:
            f.write(data or b"\0")
        whole = np.asarray(np.memmap(path, np.uint8, "r"))
        with contextlib.suppress(OSError):
            os.unlink(path)
        return cls({name: whole[at : at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in layout}, shift, most)
