"""A suffix automaton over words: the longest run ending at each word of another text that the first text contains."""

from __future__ import annotations


class SuffixAutomaton:
    """States as parallel lists; transitions as one dict per state. Built online in time linear in the words."""

    __slots__ = ("link", "long", "step")

    def __init__(self, words: list[str]) -> None:
        self.link, self.long, self.step = [-1], [0], [{}]
        link, long, step = self.link, self.long, self.step
        last = 0
        for word in words:
            here = len(long)
            long.append(long[last] + 1)
            link.append(0)
            step.append({})
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = here
                at = link[at]
            if at >= 0:
                to = step[at][word]
                if long[at] + 1 == long[to]:
                    link[here] = to
                else:
                    twin = len(long)
                    long.append(long[at] + 1)
                    link.append(link[to])
                    step.append(dict(step[to]))
                    while at >= 0 and step[at].get(word) == to:
                        step[at][word] = twin
                        at = link[at]
                    link[to] = link[here] = twin
            last = here

    def covered(self, words: list[str], shortest: int = 4) -> int:
        """How many of the words lie in runs of at least `shortest` words that the automaton's text contains."""
        link, long, step = self.link, self.long, self.step
        at = run = 0
        total = until = 0
        for i, word in enumerate(words, 1):
            while at and word not in step[at]:
                at = link[at]
                run = long[at]
            if word in step[at]:
                at = step[at][word]
                run += 1
            else:
                run = 0
            if run >= shortest:
                total += i - max(until, i - run)
                until = i
        return total
