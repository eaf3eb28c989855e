import __spark_entry__ as entry


def test_entry_and_contracts(spark):
    assert entry.entry(spark).count() == 50
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)


def test_operators_do_not_need_the_optional_subpackage():
    import pathlib
    import re

    top = pathlib.Path(entry.__file__).parent / "scopelake"
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert not re.search(r"scopelake\.llm|corpus_pipeline", f.read_text()), f
