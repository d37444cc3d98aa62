"""Paged fetching for sources behind a network: retries, pauses and early stop. The transport, clock and sleep are given."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial


class FetchError(RuntimeError):
    def __init__(self, status: int | None, message: str):
        super().__init__(message)
        self.status = status


def retryable(status: int | None) -> bool:
    """No answer at all, too many requests, or the server's fault."""
    return status is None or status == 429 or status >= 500


class Throttle:
    """Keeps a least gap between attempts."""

    def __init__(self, gap: float, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.gap, self.clock, self.sleep, self.last = gap, clock, sleep, None

    def take(self) -> None:
        if self.last is not None and (wait := self.last + self.gap - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()


def denied(status: int | None) -> bool:
    """The key is not accepted: nothing to publish around, so a run ends."""
    return status in (401, 403)


def useless(status: int | None) -> bool:
    """Whether a lookup service that answered so need not be asked again: no answer, too many requests, or its own fault."""
    return status is None or status == 429 or status >= 500


def fetch(get: Callable[..., object], url: str, backoff: list[float], sleep: Callable[[float], None], throttle: Throttle | None = None, timeout: float | None = None) -> object:
    """The answer, after a retry for each pause of `backoff` at most; other errors of the client are final at once. `timeout` goes to each attempt."""
    if timeout is not None:
        get = partial(get, timeout=timeout)
    for pause in [*backoff, None]:
        if throttle:
            throttle.take()
        try:
            return get(url)
        except FetchError as error:
            if pause is None or not retryable(error.status):
                raise
            sleep(pause)
    raise AssertionError("unreachable")


def look_up(keys: Iterable[str | None], get: Callable[..., dict], most: int, **options) -> tuple[list[dict], list[str]]:
    """(rows with their key, notes) of at most `most` keys, one after another. What is not found has no row; a service that fails is not asked again."""
    rows: list[dict] = []
    notes: list[str] = []
    for key in [k for k in keys if k is not None][:most]:
        try:
            rows.append({"key": key} | fetch(get, key, **options))
        except FetchError as error:
            if denied(error.status):
                raise
            if useless(error.status):
                notes.append(f"stopped at {key}: {error}")
                break
            if error.status != 404:
                notes.append(f"{key}: {error}")
    return rows, notes


def paged(page: Callable[[int], list], per_page: int, most: int) -> Iterator:
    """Records of pages 1, 2, ...; a short page is the last."""
    for k in range(1, most + 1):
        rows = page(k)
        yield from rows
        if len(rows) < per_page:
            return
