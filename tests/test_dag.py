import pytest

from lorespark.plans import dag


def registry():
    steps = dag.Registry("step")
    steps.register("make", lambda config, **_: {"rows": config["n"]})
    steps.register("add", lambda config, a, b=0: {"rows": a + b})
    return steps


def test_order_is_by_name_among_free_steps():
    p = dag.Pipeline("p").step("b", "make").step("a", "make").step("c", "add").after("b", "a").step("d", "add", depends_on=["a"])
    assert p.order() == ["a", "b", "c", "d"]
    assert p.describe().splitlines()[2] == "c: add after a, b"


def test_cycles_and_unknown_steps():
    with pytest.raises(ValueError, match="depend on each other"):
        dag.Pipeline("p").step("a", "make", depends_on=["b"]).step("b", "make", depends_on=["a"]).order()
    with pytest.raises(ValueError, match="unknown step"):
        dag.Pipeline("p").step("a", "make", depends_on=["z"]).order()
    with pytest.raises(ValueError, match="there already"):
        dag.Pipeline("p").step("a", "make").step("a", "make")


def test_run_resolves_references_and_config():
    p = dag.Pipeline("p", {"n": 2}).step("x", "make", outputs={"rows": "int"}).step("y", "make", outputs={"rows": "int"}).override(n=5)
    p.step("z", "add", inputs={"a": "${{ steps.x.rows }}", "b": "${{ steps.y.rows }}"}, outputs={"rows": "int"}).after("x", "y")
    assert p.validate(registry()) == [] and p.run(registry())["z"] == {"rows": 7}


@pytest.mark.parametrize("reference,why", [("${{ steps.q.rows }}", "unknown step"), ("${{ steps.y.rows }}", "depends_on"), ("${{ steps.x.other }}", "no output")])
def test_bad_references(reference, why):
    p = dag.Pipeline("p").step("x", "make", outputs={"rows": "int"}).step("y", "make", outputs={"rows": "int"}).step("z", "add", inputs={"a": reference}, depends_on=["x"])
    assert any(why in w for w in p.validate(registry()))


def test_types_of_outputs():
    steps = registry()
    steps.items["add"].inputs = {"a": "frame"}
    p = dag.Pipeline("p").step("x", "make", outputs={"rows": "int"}).step("z", "add", inputs={"a": "${{ steps.x.rows }}"}, depends_on=["x"])
    assert any("wants frame" in w for w in p.validate(steps))


def test_retries_and_callbacks():
    seen, tries, calls = [], [], dag.Registry("callback")
    calls.register("note", lambda step, level="info", **more: seen.append((step, level, sorted(more))))
    steps = dag.Registry("step")

    @steps.register("flaky")
    def flaky(config):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("no")
        return {}

    slept = []
    dag.Pipeline("p").step("a", "flaky", retry={"delay": 1}).on("success", {"note": {"level": "loud"}}).run(steps, calls, slept.append)
    assert slept == [1.0, 1.0] and seen == [("a", "loud", ["result"])]
    tries.clear()
    with pytest.raises(RuntimeError):
        dag.Pipeline("p").step("a", "flaky").on("failure", "note").run(steps, calls)
    assert seen[-1] == ("a", "info", ["error"])


def test_registry_context_and_forms():
    with pytest.raises(KeyError, match="there are: add, make"):
        registry().get("nope")
    with pytest.raises(RuntimeError):
        dag.require("spark")
    with dag.context(spark=1), dag.context(x=2):
        assert dag.require("spark") == 1 and dag.require("x") == 2
    assert dag.callback_form("a") == ("a", {}) and dag.callback_form({"name": "a", "params": {"k": 1}}) == ("a", {"k": 1})
    with pytest.raises(ValueError):
        dag.callback_form({"a": {}, "b": {}})


def test_config_functions():
    assert dag.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert dag.nested({"a.b": 1, "a.c": 2}) == {"a": {"b": 1, "c": 2}}
    assert dag.overrides({"a": {"b": True, "c": None}, "d": 1}) == ["a.b=true", "a.c=null", "d=1"]
    assert dag.effective({"root": {"a": {"b": 1, "c": 2}}, "step": {"a": {"b": 3}}}) == {"a.b": (3, "step"), "a.c": (2, "root")}


def test_yaml():
    p = dag.load("name: n\nsteps:\n  - {id: x, module: make, outputs: {rows: int}}\n  - {id: y, module: add, depends_on: [x], inputs: {a: '${{ steps.x.rows }}'}}\n")
    assert p.order() == ["x", "y"] and p.validate(registry()) == []
    with pytest.raises(ValueError, match="unknown keys"):
        dag.load("steps:\n  - {id: x, module: make, nope: 1}\n")


def test_queries_as_steps(spark):
    dag._register_operators()
    with dag.context(spark=spark):
        out = dag.Pipeline("p", {"sf_dir": "/root/testdata/sf0.001"}).step("n", "status_counts", outputs={"frame": "frame"}).run()
    assert out["n"]["frame"].first().total == 1500


def test_mocks_stand_in_for_steps():
    p = dag.Pipeline("p").step("x", "make", outputs={"rows": "int"}).step("z", "add", inputs={"a": "${{ steps.x.rows }}"}, outputs={"rows": "int"}, depends_on=["x"])
    assert p.run(registry(), mocks={"x": {"rows": 4}}) == {"x": {"rows": 4}, "z": {"rows": 4}}
    with pytest.raises(ValueError, match="lacks rows"):
        p.run(registry(), mocks={"x": {}})


def test_tools_are_steps(spark):
    dag._register_operators()
    rows = spark.createDataFrame([("a", "One"), ("b", "Two")], "article_id string, name string")
    p = dag.Pipeline("p").step("near", "similar_articles", config={"args": {"part": "tw"}}, outputs={"rows": "frame"})
    with dag.context(spark=spark, tables={"articles": rows}):
        assert [r.article_id for r in p.run()["near"]["rows"].collect()] == ["b"]


def test_command_line_lists_steps_and_shows_configuration(tmp_path, capsys):
    from lorespark.plans import cli

    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}")
    (tmp_path / "b.yaml").write_text("x: {z: 3}")
    assert cli.main(["config", f"{tmp_path}/a.yaml", f"{tmp_path}/b.yaml"]) == 0
    assert capsys.readouterr().out.splitlines() == [f"x.y = 1  [{tmp_path}/a.yaml]", f"x.z = 3  [{tmp_path}/b.yaml]"]
    assert cli.main(["list-steps"]) == 0
    shown = capsys.readouterr().out.split()
    assert {"search", "vault_tasks", "check_access", "knn_topk"} <= set(shown)
