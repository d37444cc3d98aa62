from paperflow.operators import generation


class Stub:
    """Writes what the row says: a list of answers, an exception for a failure."""

    def __init__(self):
        self.n = 0

    def complete(self, row, corrections):
        self.n += 1
        answer = row["answers"].pop(0)
        if isinstance(answer, Exception):
            raise answer
        return {"findings": answer}

    def calls(self):
        return self.n


def row(ident, *answers, subfield="s", explainability=0.5):
    return {"id": ident, "subfield": subfield + str(ident % 3), "explainability": explainability, "answers": list(answers)}


check = lambda summary: ["x"] * summary["findings"]
FAILS = [OSError("down")] * 3


def test_best_attempt():
    assert generation.write(Stub(), row(1, 3, 1, 1), check).findings == ["x"]
    assert generation.write(Stub(), row(1, 2, OSError("down")), check).findings == ["x", "x"]
    assert generation.write(Stub(), row(1, OSError("down"), 0), check).findings == []
    assert generation.write(Stub(), row(1, *FAILS), check).error == "down"


def test_day():
    day = generation.produce(Stub(), [row(n, 0) for n in range(5)], [], check)
    assert (day.outcome, day.exit_code, len(day.entries), day.shortfall) == ("published", 0, 5, None)


def test_top_up_keeps_gate_and_cap():
    chosen = [row(0, *FAILS), row(1, 0), row(2, 0), row(4, 0), row(5, 0)]
    rest = [row(7, 0), row(9, 0, explainability=0.1), row(12, 0), row(15, 0)]
    day = generation.produce(Stub(), chosen, rest, check)
    assert [r["id"] for r, _ in day.entries] == [1, 2, 4, 5, 12] and day.dropped == [(0, "summarisation_failed")] and day.outcome == "published_degraded"


def test_too_few_and_budget():
    assert generation.produce(Stub(), [row(1, 0), row(2, 0)], [], check).outcome == "aborted"
    day = generation.produce(Stub(), [row(n, 0) for n in range(5)], [], check, max_calls=3)
    assert len(day.entries) == 3 and day.degradations[0][0] == "budget" and day.shortfall == "candidate-shortage"
    assert generation.produce(Stub(), [], [], check).exit_code == 1


def test_notes_and_cost():
    assert generation.by_source([("a", "1"), ("b", "2"), ("a", "3")]) == [("a", "1; 3"), ("b", "2")]
    assert generation.cost(1_000_000, 0, 0, 0, (5.0, 25.0)) == 5.0 and generation.cost(1, 1, 1, 1, None) is None
