"""What an operator leaves behind in workers and on disk."""

import json
import time
import weakref
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snarewatch.llm import bpe, common, jaccard_join, pii


def steps(spark, monkeypatch):
    """The Arrow functions of the Jaccard join's survey and of the masking, as they are sent out."""
    sent = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema, *a: sent.append(run) or (_ for _ in ()).throw(InterruptedError))
    for build in (lambda d: jaccard_join.similar_documents(d), lambda d: pii.mask_documents(d), lambda d: pii.personal_data(d)):
        with pytest.raises(InterruptedError):
            build(spark.createDataFrame([(1, "some text")], "doc_id bigint, text string"))
    return sent


def test_a_worker_gives_up_the_encoder_when_another_operator_comes(spark, monkeypatch, tmp_path):
    letters = bpe._byte_letters()
    (tmp_path / "vocabulary").write_text(json.dumps({"model": {"vocab": {c: i for c, i in letters.items()}, "merges": []}, "added_tokens": []}))
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon({b" a": (32, 97)}))
    monkeypatch.setattr(bpe.SparkFiles, "get", lambda name: str(Path(tmp_path, name)))
    sent = steps(spark, monkeypatch)
    assert len(sent) == 3
    for run in sent:
        encoder = bpe._encoder(("lexicon", "vocabulary"))
        assert encoder is bpe._encoder(("lexicon", "vocabulary"))
        left = weakref.ref(encoder)
        del encoder
        list(run(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "text"])][:0])))
        assert left() is None


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


@pytest.mark.parametrize("write", [common.checkpoint, common.written, common.collected])
def test_shuffle_files_go_with_the_step_that_made_them(spark, write):
    common.ensure_checkpoint_dir(spark)
    before, held = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO, None)
    df = spark.range(4000, numPartitions=4).groupBy((F.col("id") % 1000).alias("k")).count()
    out = write(df)
    assert sorted(map(tuple, out if isinstance(out, list) else out.collect())) == [(k, 4) for k in range(1000)]
    assert spark.conf.get(common.SHUFFLES_GO, None) == held
    for _ in range(50):  # they go in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    again = df.collect() if write is common.collected else []  # a query that is run again makes them anew
    assert len(again) in (0, 1000)
