"""The store as a set of named tools over plain values, for a server or an agent framework to expose."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.sources import observations
from tidemark.store import MemoryStore


class MemoryService:
    """The store's operations for one caller at a time; the only place that reads a clock, and only where no time is given."""

    def __init__(self, store: MemoryStore, clock: Callable[[], float] = time.time):
        self.store, self.clock, self.spark = store, clock, store.spark
        self.writing = threading.Lock()  # a write's id follows from those before it

    def tools(self) -> dict[str, Callable[..., object]]:
        return {name: getattr(self, name) for name in ("write", "query", "answer", "answer_path", "answer_who", "consolidate", "forget", "metrics", "stats", "drop", "namespaces")}

    def write(self, text: str, namespace: str = "default", session_id: str = "s0", timestamp: float | None = None, fact: dict | None = None) -> dict:
        """Store one observation; returns its receipt."""
        with self.writing:
            top = self.store.log().agg(F.max("id")).first()[0]
            new = 0 if top is None else top + 1
            told = None if fact is None else (fact.get("subject"), fact.get("predicate"), fact.get("object"), fact.get("valid_from"))
            row = (namespace, session_id, new, new, self.clock() if timestamp is None else float(timestamp), "user", None, text, told)
            return self.store.write(self.spark.createDataFrame([row], observations.OBSERVATION)).first().asDict()

    def query(self, question: str, namespace: str = "default", timestamp: float | None = None) -> dict:
        lines = self.store.memories(namespace, question, self.clock() if timestamp is None else float(timestamp))
        return {"context": lines}

    def answer(self, subject: str, predicate: str, namespace: str = "default", as_of: float | None = None) -> dict:
        return {"object": self.store.answer(namespace, subject, predicate, as_of)}

    def answer_path(self, subject: str, predicates: list[str], namespace: str = "default", as_of: float | None = None) -> dict:
        return {"object": self.store.answer_path(namespace, subject, predicates, as_of)}

    def answer_who(self, predicate: str, obj: str, namespace: str = "default", as_of: float | None = None) -> dict:
        return {"subjects": self.store.answer_who(namespace, predicate, obj, as_of)}

    def forget(self, subject: str, namespace: str = "default") -> dict:
        self.store.forget(self.spark.createDataFrame([(namespace, subject)], "namespace string, subject string"))
        return {"forgotten": subject}

    def metrics(self) -> list[dict]:
        return [r.asDict() for r in self.store.metrics().collect()]

    def consolidate(self) -> list[dict]:
        return [r.asDict() for r in self.store.consolidate().collect()]  # a row per tenant

    def stats(self) -> list[dict]:
        return [r.asDict() for r in self.store.stats().collect()]

    def drop(self, namespace: str) -> dict:
        self.store.drop(namespace)
        return {"dropped": namespace}

    def namespaces(self) -> list[str]:
        return sorted(r[0] for r in self.store.log().select("namespace").distinct().collect())
