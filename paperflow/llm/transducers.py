"""Small deterministic transducers, their composition, and the ones that the toxicity grammar is made of.

A transducer reads the symbols of a clause one at a time; `step` gives the next state and what is written, `last` what
is written at the clause's end. Composed, the second reads what the first writes. Symbols: I and J are a strong and a
weak insult, T a threat, Y a target, N a negation, R reported speech, - any other word. An insult or threat comes out
with a mark: t targeted, n negated, r reported, none if plain."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass, field

MARKED = frozenset("IJT")
State = Hashable
Step = Callable[[State, str], tuple[State, tuple[str, ...]]]


@dataclass(frozen=True)
class Transducer:
    start: State
    step: Step
    last: Callable[[State], tuple[str, ...]] = lambda state: ()

    def compose(self, then: Transducer) -> Transducer:
        """What `then` writes when it reads what this one writes."""

        def through(state: State, symbols: Iterable[str]) -> tuple[State, tuple[str, ...]]:
            written: list[str] = []
            for symbol in symbols:
                state, out = then.step(state, symbol)
                written.extend(out)
            return state, tuple(written)

        def step(state: State, symbol: str) -> tuple[State, tuple[str, ...]]:
            first, out = self.step(state[0], symbol)
            second, written = through(state[1], out)
            return (first, second), written

        def last(state: State) -> tuple[str, ...]:
            second, written = through(state[1], self.last(state[0]))
            return written + then.last(second)

        return Transducer((self.start, then.start), step, last)


def negation(reach: int) -> Transducer:
    """Marks what stands within `reach` words after a negation."""

    def step(left: int, symbol: str) -> tuple[int, tuple[str, ...]]:
        if symbol == "N":
            return reach, ("-",)
        return max(0, left - 1), (symbol + "n" if left and symbol in MARKED else symbol,)

    return Transducer(0, step)


def reported() -> Transducer:
    """Marks what stands after reported speech, to the clause's end, whatever mark it had."""

    def step(told: bool, symbol: str) -> tuple[bool, tuple[str, ...]]:
        if symbol == "R":
            return True, ("-",)
        return told, (symbol[0] + "r" if told and symbol[0] in MARKED else symbol,)

    return Transducer(False, step)


def targets(reach: int) -> Transducer:
    """Marks what has a target within `reach` words before or after; unmarked ones wait that long for one."""

    def step(state: tuple[int, tuple], symbol: str) -> tuple[tuple[int, tuple], tuple[str, ...]]:
        left, waiting = state
        waiting = tuple((age + 1, kind) for age, kind in waiting)
        late = tuple(kind for age, kind in waiting if age > reach)
        waiting = waiting[len(late) :]
        if symbol == "Y":
            return (reach, ()), late + tuple(kind + "t" for _, kind in waiting)
        if symbol in MARKED:
            if left:
                return (left - 1, waiting), (*late, symbol + "t")
            return (0, (*waiting, (0, symbol))), late
        return (max(0, left - 1), waiting), late + ((symbol,) if symbol[0] in MARKED else ())

    return Transducer((0, ()), step, lambda state: tuple(kind for _, kind in state[1]))


@dataclass
class Machine:
    """A transducer's table, filled with the arcs that are met."""

    transducer: Transducer
    arcs: dict = field(default_factory=dict)

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.transducer.start, []
        for symbol in symbols:
            key = (state, symbol)
            arc = self.arcs.get(key)
            if arc is None:
                arc = self.arcs[key] = self.transducer.step(state, symbol)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        return out + list(self.transducer.last(state))


def grammar(negation_reach: int, target_reach: int) -> Transducer:
    return negation(negation_reach).compose(reported()).compose(targets(target_reach))
