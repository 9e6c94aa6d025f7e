"""The feature pipeline on a file stream gives the batch result."""

from __future__ import annotations

from places import SF001

from txrisk.operators.features import create_features
from txrisk.streaming.features_stream import run_feature_stream


def test_X02_stream_equals_batch(spark, tx, tmp_out):
    streamed = run_feature_stream(spark, SF001, tmp_out("stream"))
    batch = create_features(tx)
    assert streamed.count() == batch.count()
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0


def test_X02_restart_from_checkpoint_adds_nothing(spark, tmp_out):
    out = tmp_out("stream-restart")
    first = run_feature_stream(spark, SF001, out).count()
    again = run_feature_stream(spark, SF001, out).count()  # same sink, same checkpoint
    assert first == again == 1000
