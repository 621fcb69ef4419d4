"""Registered queries of the subpackage against their SQL, and independence of the rest from it."""

import re
from pathlib import Path

import pytest

from tests.test_entry import compare
from tideguard.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", name, registry.queries()[name], registry.oracle_sql()[name])


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    others = [p for p in (root / "tideguard").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any("llm" in p.read_text() for p in others)


def test_scratch_folders_are_removed(spark):
    from tideguard.llm.common import new_path, scratch, stored

    kept = new_path(spark, "kept")
    with scratch(spark):
        inner = stored(spark.range(5).toDF("i"), "inner").stored_at
        with scratch(spark):
            innermost = stored(spark.range(5).toDF("i"), "inner").stored_at
        result = stored(spark.read.parquet(inner).where("i > 2"), "kept", path=kept)
    gone = [Path(p.removeprefix("file://")).exists() for p in (inner, innermost)]
    assert gone == [False, False] and result.count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tideguard.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
