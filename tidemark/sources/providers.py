"""Models behind functions: embedders, completers and scorers, called in bounded batches where the rows are."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


@dataclass(frozen=True)
class Provider:
    """A model as a function of a list of texts that answers each, in order.

    batch: most texts of a call. retries: further tries of a call that failed by the network or by time, after waits that double;
    then the failure is the caller's. Another number of answers than texts fails at once.
    """

    call: Callable[[list[str]], Sequence]
    model_id: str
    batch: int = 64
    retries: int = 3
    wait: float = 0.1

    def __call__(self, texts: list[str]) -> list:
        out: list = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            got = list(self._tried(part))
            if len(got) != len(part):
                raise ValueError(f"{self.model_id} gave {len(got)} answers to {len(part)} texts")
            out += got
        return out

    def _tried(self, part: list[str]) -> Sequence:
        for n in range(self.retries + 1):
            try:
                return self.call(part)
            except OSError:  # timeouts and lost connections are among them
                if n == self.retries:
                    raise
                time.sleep(self.wait * 2**n)
        raise AssertionError


def _column(text: Column, provider: Provider, kind: str, arrow: pa.DataType, form: Callable) -> Column:
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            texts = p.to_pylist()
            known = [t for t in texts if t is not None]
            answers = iter(provider(known))
            yield pa.array([None if t is None else form(next(answers)) for t in texts], arrow)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)(text)


def embedded(text: Column, provider: Provider) -> Column:
    """A text's vector; null for a null text."""
    return _column(text, provider, "array<double>", pa.list_(pa.float64()), lambda v: [float(x) for x in v])


def completed(text: Column, provider: Provider) -> Column:
    """The model's answer to a prompt; null for a null one."""
    return _column(text, provider, "string", pa.string(), str)


def logprobs(text: Column, provider: Provider) -> Column:
    """Log-probabilities of a text's tokens, as operators.gate.predictive_surprise takes them; unknown ones are null."""
    return _column(text, provider, "array<double>", pa.list_(pa.float64()), lambda v: [None if x is None else float(x) for x in v])
