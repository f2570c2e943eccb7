"""The command: arguments, a list, a pipe and typed lines end in the same reports."""

import datetime as dt
import io
import json
from pathlib import Path

import pytest

from onomast import __main__ as command
from onomast.sources import names

AT = dt.datetime(2024, 5, 6, 7, 8)


class Typed:
    """Lines of a terminal, which ends in an interrupt."""

    def __init__(self, *lines):
        self.lines = lines

    def isatty(self):
        return True

    def __iter__(self):
        yield from self.lines
        raise KeyboardInterrupt


@pytest.fixture
def place(tmp_path):
    values = [{"code": "b_1mp", "label": "VELORIA"}, {"code": "b_2mp", "label": "NIMRA HOME"}]
    (tmp_path / "c.json").write_text(json.dumps({"values_lists": [{"values": values}]}))
    return tmp_path


def reported(paths):
    return Path(paths["csv"]).read_text(encoding="utf-8-sig").splitlines()[1:]


def test_names_list_and_typed_lines(spark, place):
    (place / "n.txt").write_text("veloria\n\nzzzz\n")
    base = ["-c", str(place / "c.json"), "-o", str(place / "r" / "out.txt")]
    said = io.StringIO()
    paths = command.run(spark, names.parse_arguments([*base, "veloria", "zzzz"]), out=said, at=AT)
    want = reported(paths)
    assert want == ['"veloria","REVIEW","VELORIA (b_1mp)"', '"zzzz","ALLOW",""'] and paths["txt"] == str(place / "r" / "out.txt")
    assert said.getvalue().count("Brand check") == 2 and "Wrote " in said.getvalue()
    assert json.loads(Path(paths["timing"]).read_text())["counts"] == {"catalogueBrands": 2, "namesChecked": 2}
    assert reported(command.run(spark, names.parse_arguments([*base, "-i", str(place / "n.txt")]), out=said, at=AT)) == want
    said = io.StringIO()
    assert reported(command.run(spark, names.parse_arguments(base), Typed("veloria\n", " \n", "zzzz\n"), said, AT)) == want
    assert "Interrupted after 2 names." in said.getvalue()


def test_faults(spark, place):
    assert command.main(["--help"]) == 0 and command.main(["--what"]) == 2 and command.main(["-c"]) == 2
    with pytest.raises(ValueError, match="--catalogue"):
        command.run(spark, names.parse_arguments(["x"]))
    none = command.run(spark, names.parse_arguments(["-c", str(place / "c.json"), "-o", str(place / "e")]), Typed(), io.StringIO(), AT)
    assert list(none) == ["timing"]
