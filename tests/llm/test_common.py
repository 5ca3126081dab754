import gc
import weakref

from meltframe.llm.common import per_worker


class Model:
    pass


def test_a_worker_holds_only_what_its_last_task_needed():
    first = weakref.ref(per_worker(("model", 1), Model))
    assert per_worker(("model", 1), Model) is first()
    second = per_worker(("model", 2), Model)
    gc.collect()
    assert first() is None
    assert per_worker(("model", 2), Model) is second


def test_a_pipeline_stage_frees_the_model_of_the_stage_before(spark, docs_of):
    from meltframe.llm import near_dedup

    def parsers_left(batches):
        import sys

        import pyarrow as pa

        near_dedup._shingler(4)
        held = sys.modules["meltframe_worker_state"].__dict__
        names = [str(k) for x in (held, held.get("held", {})) for k in x]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum("language parser" in n for n in names)] * batch.num_rows, pa.int64())], ["left"])

    from meltframe.llm import language

    docs = docs_of([(i, f"some words about number {i}") for i in range(40)]).repartition(4).persist()
    assert language.identify(docs, {"en": ["some words about a number"]}).count() == 40
    left = docs.select("doc_id").mapInArrow(parsers_left, "left long").agg({"left": "max"}).first()[0]
    docs.unpersist()
    assert left == 0
