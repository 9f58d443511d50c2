from types import SimpleNamespace

import pytest

from trelliq.llm import common


@pytest.mark.parametrize(("total", "collected"), [(370, 0), (380, 1)])
def test_driver_gives_memory_back_once_half_of_its_heap_is_taken(total, collected):
    calls = []
    runtime = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 750)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=SimpleNamespace(gc=lambda: calls.append(1)))
    common.rest_driver(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert len(calls) == collected


def test_each_scratch_table_lets_the_driver_rest(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "rest_driver", calls.append)
    scratch = common.Scratch(spark, "test")
    assert scratch.keep(spark.range(3)).count() == 3 and calls == [spark]
