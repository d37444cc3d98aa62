import pytest

from paperflow.config import Category, Config, ConfigError, Limit
from paperflow.sources import feeds
from paperflow.sources.fetch import FetchError, Throttle, fetch, look_up, paged

WEEK = tuple(Category(f"c{d}", d) for d in range(1, 8))


def test_config():
    assert Config(WEEK).category(3).key == "c3"
    broken = [
        ({"weights": {"a": 0.6, "b": 0.3}}, "sum to 1"), ({"weights": {"a": 0.4, "b": 0.6}}, "fall"), ({"relaxed_cap": 1}, "relaxed"), ({"least_papers": 6}, "least number"), ({"categories": WEEK[:6]}, "weekday"),
        ({"categories": (*WEEK[:6], Category("c1", 7))}, "keys"), ({"limits": {"r": Limit(10, 5)}}, "hard limit"), ({"limits": {"r": Limit(5, 10, True)}}, "hard limit"), ({"backoff_ms": (1,)}, "backoff"),
    ]
    for change, message in broken:
        with pytest.raises(ConfigError, match=message):
            Config(**{"categories": WEEK} | change)


def test_fetch():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = [FetchError(503, "x"), FetchError(None, "x"), "good"]

    def get(_):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch(get, "u", [1, 3], sleep, Throttle(2, lambda: now[0], sleep)) == "good"
    assert slept == [1, 1, 3]
    answers[:] = [FetchError(404, "x"), "never"]
    with pytest.raises(FetchError):
        fetch(get, "u", [1, 3], sleep)
    assert answers == ["never"]
    assert list(paged(lambda k: [k] * (2 if k < 3 else 1), 2, 9)) == [1, 1, 2, 2, 3] and list(paged(lambda k: [k, k], 2, 2)) == [1, 1, 2, 2]


def test_timeouts_lookups_and_paged_works(spark):
    assert fetch(lambda url, timeout: (url, timeout), "u", [], print, timeout=3) == ("u", 3)
    answers = {"a": {"tldr": "A"}, "b": FetchError(404, "none"), "c": FetchError(400, "odd"), "d": FetchError(500, "down"), "e": {"tldr": "E"}, "x": FetchError(403, "no key")}

    def get(key):
        if isinstance(answers[key], Exception):
            raise answers[key]
        return answers[key]

    options = {"backoff": [], "sleep": lambda s: None}
    assert look_up(["a", None, "b", "c", "d", "e"], get, 20, **options) == ([{"key": "a", "tldr": "A"}], ["c: odd", "stopped at d: down"])
    assert look_up(["a", "e", "d"], get, 2, **options)[0][1]["key"] == "e"
    with pytest.raises(FetchError):
        look_up(["x"], get, 20, **options)
    record = lambda n: {"id": f"https://openalex.org/W{n}", "title": f"t {n}", "publication_date": "2026-03-02"}
    pages = {1: [record(1), record(2)], 2: [record(3)]}
    assert sorted(r.id for r in feeds.fetched_works(spark, lambda k: pages[k], 2, 5).collect()) == ["W1", "W2", "W3"]
    assert feeds.fetched_works(spark, lambda k: [], 2, 5).count() == 0
