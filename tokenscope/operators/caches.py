"""Caches that forget: a schema cache with recency and age, and sessions that are used again.

Like the classes of ``state``, each has one step method and runs in batch (state.replay) and on a stream
(streaming.stateful.decide), one cache per key.
"""

from __future__ import annotations

from collections import OrderedDict


class AgedCache:
    """At most most entries of at most seconds of age. A get makes an entry the most recent but no younger; a set does both.

    A set of a new entry puts the least recent one out when the cache is full, expired or not. An expired entry goes when it is
    asked for. Answers: hit, miss, expired; update, insert, insert_evict; deleted, absent.
    """

    def __init__(self, most: int = 100, seconds: float = 3600.0) -> None:
        self.most = most if most > 0 else 100
        self.seconds = seconds if seconds > 0 else 3600.0
        self.created: OrderedDict[object, float] = OrderedDict()

    def step(self, ts: float, kind: str, entry: object) -> str:
        held = self.created.get(entry)
        if kind == "get":
            if held is None:
                return "miss"
            if ts - held > self.seconds:
                del self.created[entry]
                return "expired"
            self.created.move_to_end(entry)
            return "hit"
        if kind == "delete":
            return "absent" if self.created.pop(entry, None) is None else "deleted"
        evict = held is None and len(self.created) >= self.most
        if evict:
            self.created.popitem(last=False)
        self.created[entry] = ts
        self.created.move_to_end(entry)
        return "update" if held is not None else "insert_evict" if evict else "insert"


class SessionReuse:
    """The session of a server: used again within seconds of its last use, else made anew; at most most sessions.

    When there is no room for a new one, the one goes that was not used for longest, of equals the least name.
    Answers: reuse, create, create_evict.
    """

    def __init__(self, most: int = 100, seconds: float = 300.0) -> None:
        self.most = most if most > 0 else 100
        self.seconds = seconds if seconds > 0 else 300.0
        self.used: dict[object, float] = {}

    def step(self, ts: float, server: object) -> str:
        last = self.used.pop(server, None)
        if last is not None and ts - last < self.seconds:
            self.used[server] = ts
            return "reuse"
        evict = len(self.used) >= self.most
        if evict:
            del self.used[min(self.used, key=lambda x: (self.used[x], x))]
        self.used[server] = ts
        return "create_evict" if evict else "create"
