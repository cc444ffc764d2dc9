import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstrata.llm import chat_template as C


def test_language():
    t = C.Template("{% if a.b == 'x' and not c %}1{% elif c > 2 %}2{% else %}3{% endif %}{{ 'q' + \"w\" | upper }}{% for i in l %}[{{ i }}{{ n }}]{% endfor %}{{ l[1] }}{{ none }}{{ (l | length) + 1 }}")
    assert t.render(a={"b": "x"}, c=0, l=[7, 8], n="!")[0] == "1qW[7!][8!]83"
    assert t.render(a={"b": "y"}, c=3, l=[], n="")[0] == "2qW1"
    assert t.render(a={"b": "y"}, c=1, l=[], n="")[0] == "3qW1"


def test_constants_fold_to_one_literal():
    assert C.Template("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif true %}d{% else %}y{% endif %}{{ '<' | escape }}").tree == (C.Output(C.Const("abcd\\l")),)


@pytest.mark.parametrize("bad", ["{{ f(1) }}", "{{ a. }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a | nofilter }}", "{% import os %}", "{{ a ~ b }}", "{{ 'x }}"])
def test_bad_templates(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad)


def test_sandbox():
    for source in ("{{ a.__class__ }}", "{{ 'x'.upper }}", "{{ b }}"):
        with pytest.raises(C.TemplateError):
            C.Template(source).render(a="text")
    assert C.Template("{{ a.__class__ }}").render(a={})[0] == ""


@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=60))), st.text("\\<>lg/turn \n", max_size=30))
def test_round_trip(turns, odd):
    turns = [*turns, ("assistant", odd), ("user", odd)]
    text, spans = C.Template(C.TEMPLATE).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert C.read_back(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", C.SAYS, 5), (1, 0, "user", None, 5), (1, 1, "assistant", "a", 5), (1, 1, "assistant", "a", 5), (None, 0, None, "x", 5), (2, 0, "assistant", "y" * 100_000, 5)]
    got = {r.conv_id: r for r in C.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")).collect()}
    assert C.read_back(got[1].formatted) == [("user", ""), ("assistant", C.SAYS), ("assistant", "a"), ("assistant", "a")]
    assert got[1].n_turns == 4 and C.read_back(got[None].formatted) == [("", "x")] and len(C.read_back(got[2].formatted)[0][1]) == 100_000
    assert [r.conv_id for r in C.report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect()] == [-7]
