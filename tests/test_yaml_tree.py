import pytest

from sourcelake.functions.yaml_tree import scan

PIN = "a" * 40


@pytest.mark.parametrize(
    ("text", "kinds", "partial"),
    [
        (None, [], False),
        ("", [], False),
        ("\ton: x", ["github_workflow_triggers"], True),
        ("%YAML 1.2\n---\non: push\r\n", ["github_workflow_triggers"], False),
        ("%TAG ! x", [], True),
        ('"o\\u006e": push', [], True),
        ("<<: *base", [], True),
        ("? on", [], True),
        # a list as deep as its key counts as the job's own entry
        (f"jobs:\n  a:\n    steps:\n    - uses: o/r@{PIN} # v1", ["github_workflow_uses"], False),
        (f"jobs:\n  a:\n    steps:\n      - uses: o/r@{PIN} # v1", ["github_workflow_uses"], False),
        ("jobs:\n  a:\n    steps:\n      - uses: 'docker://i:1'", ["github_workflow_uses", "github_workflow_mutable_ref"], False),
        (f"jobs:\n  a:\n    uses: docker://i@sha256:{'b' * 64}", ["github_workflow_uses"], False),
        ("run: >-\n  on: x\non: [push]", ["github_workflow_triggers"], False),
    ],
)
def test_workflow(text, kinds, partial):
    got = scan(text, "workflow")
    assert ([s["kind"] for s in got["signals"]], got["partial"]) == (kinds, partial)


def test_compose_sequence_of_services_is_partial():
    assert scan("services:\n  - a: 1\n", "compose") == {"partial": True, "signals": []}


def test_other_files_are_not_read():
    assert scan("on: push", None) == {"partial": False, "signals": []}
