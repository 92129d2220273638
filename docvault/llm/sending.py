"""Broadcasts that workers open without a copy of this package: objects go as bytes, pickled by value."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, SparkContext, cloudpickle


def send(context: SparkContext, value) -> Broadcast:
    return context.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """The object in a task."""
    return pickle.loads(sent.value)
