"""Minimal acyclic automata of sorted words, with perfect-hash word numbers and completion with one error."""

from __future__ import annotations


class Automaton:
    """The smallest automaton of a sorted list of different words.

    A state's edges map a character to (target, words numbered before those of the edge), so the sum along a
    path is the word's place in the list. Only the states of the last word are open while it is built; a state
    is closed when no further word can reach it, and equal closed states are one.
    """

    def __init__(self, words):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        before = ""

        def close(depth: int) -> None:
            while len(path) > depth:
                state = self._state(known, *path.pop())
                path[-1][1].append((before[len(path) - 1], state))

        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            close(same + 1)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            before = word
        close(1)
        self.root = self._state(known, *path.pop())

    def _state(self, known: dict, final: bool, edges: list) -> int:
        key = (final, *edges)
        if key not in known:
            known[key] = len(self.edges)
            size, numbered = int(final), {}
            for c, target in edges:
                numbered[c] = (target, size)
                size += self._sizes[target]
            self.edges.append(numbered)
            self.final.append(final)
            self._sizes.append(size)
        return known[key]

    def __len__(self) -> int:
        return self._sizes[self.root]

    def walk(self, text: str) -> tuple[int, int] | None:
        """(state, number of the first word below it) after a text; None if no word begins so."""
        state, number = self.root, 0
        for c in text:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The place of a word in the list, None if it isn't in it."""
        at = self.walk(word)
        return at[1] if at and self.final[at[0]] else None

    def with_one_error(self, head: str, rest: str) -> set[int]:
        """Numbers of the words head + x, where x differs from ``rest`` by exactly one inserted, deleted or replaced character."""
        found: set[int] = set()
        if (at := self.walk(head)) is None:
            return found
        edges, final = self.edges, self.final

        def exactly(state: int, number: int, place: int) -> None:
            for c in rest[place:]:
                step = edges[state].get(c)
                if step is None:
                    return
                state, number = step[0], number + step[1]
            if final[state]:
                found.add(number)

        state, number = at
        for place in range(len(rest) + 1):
            here, c = edges[state], rest[place : place + 1]
            if c:
                exactly(state, number, place + 1)
            for d, (target, skipped) in here.items():
                if d != c:  # a c inserted before a c is one inserted after it
                    exactly(target, number + skipped, place)
                    if c:
                        exactly(target, number + skipped, place + 1)
            if (step := here.get(c)) is None:
                break
            state, number = step[0], number + step[1]
        return found
