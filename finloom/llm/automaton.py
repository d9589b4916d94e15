"""Deterministic automata over bytes, compiled from a small regular-expression language.

Expressions know literals, escapes (``\\x20``, ``\\.``), classes, groups,
alternatives and the repeats ``* + ? {m} {m,} {m,n}``; every expression is a
plain regular language. All rules are compiled together: Thompson automaton,
subset construction over the byte classes that the rules tell apart, then
minimisation by partition refinement into one transition array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple


def parse(pattern: str) -> Node:
    """The expression as nested ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""
    place = 0

    def peek() -> str:
        return pattern[place : place + 1]

    def take() -> str:
        nonlocal place
        place += 1
        return pattern[place - 1]

    def escaped() -> int:
        nonlocal place
        c = take()
        if c == "x":
            place += 2
            return int(pattern[place - 2 : place], 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c} in {pattern!r}")
        return ord(c)

    def one_class() -> Node:
        wanted, negated = set(), False
        if peek() == "^":
            take()
            negated = True
        while peek() != "]":
            c = take()
            low = high = escaped() if c == "\\" else ord(c)
            if peek() == "-" and pattern[place + 1 : place + 2] != "]":
                take()
                c = take()
                high = escaped() if c == "\\" else ord(c)
            wanted |= set(range(low, high + 1))
        take()
        return ("set", frozenset(set(range(256)) - wanted if negated else wanted))

    def atom() -> Node:
        c = take()
        if c == "(":
            inner = alternatives()
            if take() != ")":
                raise ValueError(f"unclosed group in {pattern!r}")
            return inner
        if c == "[":
            return one_class()
        if c == "\\":
            return ("set", frozenset([escaped()]))
        return ("cat", *(("set", frozenset([b])) for b in c.encode()))

    def repeated() -> Node:
        nonlocal place
        node = atom()
        while peek() and peek() in "*+?{":
            c = take()
            if c == "{":
                end = pattern.index("}", place)
                low, comma, high = pattern[place:end].partition(",")
                place = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, 1 if c == "+" else 0, 1 if c == "?" else None)
        return node

    def sequence() -> Node:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", *parts)

    def alternatives() -> Node:
        parts = [sequence()]
        while peek() == "|":
            take()
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    tree = alternatives()
    if place != len(pattern):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return tree


def fold_case(node: Node) -> Node:
    """The same expression for letters of either case."""
    if node[0] == "set":
        both = {ord(chr(b).swapcase()) for b in node[1] if b < 128 and chr(b).isalpha()}
        return ("set", node[1] | both)
    return tuple(fold_case(x) if isinstance(x, tuple) else x for x in node)


def mirrored(node: Node) -> Node:
    """The language of the reversed strings."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    return (node[0], *map(mirrored, node[:0:-1] if node[0] == "cat" else node[1:]))


def relaxed(node: Node, most: int) -> Node:
    """A larger language: repeats of more than ``most`` ask for ``most`` or more, which keeps automata of many rules small."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        inner, low, high = node[1:]
        return ("rep", relaxed(inner, most), most, None) if low > most else ("rep", relaxed(inner, most), low, high)
    return (node[0], *(relaxed(x, most) for x in node[1:]))


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state, state 0 is dead, ``start`` begins; ``accepts[state]`` has a bit per rule."""

    step: np.ndarray
    accepts: np.ndarray
    start: int


class _Thompson:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def new(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: Node, begin: int) -> int:
        """The end of ``node`` entered at ``begin``."""
        if node[0] == "set":
            end = self.new()
            self.moves[begin].append((node[1], end))
            return end
        if node[0] == "cat":
            for part in node[1:]:
                begin = self.add(part, begin)
            return begin
        if node[0] == "alt":
            ends = []
            for part in node[1:]:
                entry = self.new()
                self.empty[begin].append(entry)
                ends.append(self.add(part, entry))
            end = self.new()
            for x in ends:
                self.empty[x].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            begin = self.add(inner, begin)
        if high is None:
            loop, end = self.new(), self.new()
            self.empty[begin] += [loop, end]
            self.empty[self.add(inner, loop)] += [loop, end]
            return end
        end = self.new()
        self.empty[begin].append(end)
        for _ in range(high - low):
            entry = self.new()
            self.empty[begin].append(entry)
            begin = self.add(inner, entry)
            self.empty[begin].append(end)
        return end


def compile_rules(trees: list[Node], anywhere: bool) -> Automaton:
    """One minimal automaton for all rules; with ``anywhere`` a match may begin at every byte."""
    nfa = _Thompson()
    root = nfa.new()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        entry = nfa.new()
        nfa.empty[root].append(entry)
        final[nfa.add(tree, entry)] = k
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))

    # bytes that no rule tells apart share a class
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    classes = sorted(set(signature.values()))
    class_of = np.array([classes.index(signature[b]) for b in range(256)])
    sample = [int(np.flatnonzero(class_of == k)[0]) for k in range(len(classes))]

    def closed(states) -> frozenset:
        found, queue = set(states), list(states)
        while queue:
            for x in nfa.empty[queue.pop()]:
                if x not in found:
                    found.add(x)
                    queue.append(x)
        return frozenset(found)

    subsets = {frozenset(): 0, closed([root]): 1}
    queue, rows = [closed([root])], [[0] * len(classes)]
    while queue:
        subset = queue.pop(0)
        row = []
        for byte in sample:
            after = closed({end for x in subset for s, end in nfa.moves[x] if byte in s})
            if after not in subsets:
                subsets[after] = len(subsets)
                queue.append(after)
            row.append(subsets[after])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(1 << final[x] for x in s if x in final) for s in subsets], np.int64)

    # minimisation: split blocks until all states of a block move alike
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    for state in [0, *range(1, len(block))]:  # the dead state stays 0
        if order[block[state]] < 0:
            order[block[state]] = order.max() + 1
    number = order[block]
    step = np.zeros((order.max() + 1, len(classes)), np.int32)
    step[number] = number[table]
    kept = np.zeros(len(step), np.int64)
    kept[number] = accepts
    return Automaton(step[:, class_of], kept, int(number[1]))


class Scanner:
    """Finds every rule's leftmost, longest, non-overlapping matches.

    One pass from the end of the text to its beginning runs the automaton of
    the reversed rules, with long counted repeats relaxed, and marks the places
    where a match may begin; at the marked places that are still free, the
    rule's own automaton then runs forward to the match's last end, if any.
    """

    MOST_COUNTED = 3

    def __init__(self, trees: list[Node]):
        back = compile_rules([mirrored(relaxed(t, self.MOST_COUNTED)) for t in trees], anywhere=True)
        self._rows = [[None] * 257 for _ in back.accepts]
        for k, row in enumerate(self._rows):
            row[:256] = [self._rows[x] for x in back.step[k].tolist()]
            row[256] = int(back.accepts[k])
        self._start = self._rows[back.start]
        self._forward = []
        for tree in trees:
            one = compile_rules([tree], anywhere=False)
            self._forward.append((one.step.tolist(), one.accepts.tolist(), one.start))

    def marks(self, data: bytes) -> list[tuple[int, int]]:
        """Places where a match begins, the last first, with the rules' bits."""
        found = []
        place, row = len(data), self._start
        for byte in reversed(data):
            place -= 1
            row = row[byte]
            if row[256]:
                found.append((place, row[256]))
        return found

    def longest(self, rule: int, data: bytes, begin: int) -> int:
        """Where the rule's longest match at ``begin`` ends; ``begin`` itself if there is none."""
        step, accepts, state = self._forward[rule]
        end = begin
        for place in range(begin, len(data)):
            state = step[state][data[place]]
            if not state:
                break
            if accepts[state]:
                end = place + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by rule and start."""
        marks = self.marks(data)
        found = []
        for rule in range(len(self._forward)) if marks else ():
            free = 0
            for place, bits in reversed(marks):
                if bits >> rule & 1 and place >= free:
                    end = self.longest(rule, data, place)
                    if end > place:
                        free = end
                        found.append((rule, place, end))
        return found
