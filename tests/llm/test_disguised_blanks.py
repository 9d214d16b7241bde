import time

import pytest

from clausewise.llm import personal as P


@pytest.mark.parametrize("text", ["parze-sha" + " " * 9 + "[at] litigroup [dot] test", "parze-sha\t  \n    \t(at) litigroup" + " " * 7 + "[dot] test"])
def test_any_number_of_blanks_before_a_bracket(text):
    assert P.redact(f"邮箱：{text}，抄送") == "邮箱：[EMAIL]，抄送"


def test_long_runs_of_blanks_take_time_in_proportion():
    began = time.time()
    P.redact(" " * 400_000 + "(at) a" + " " * 400_000 + "dot")
    assert time.time() - began < 20
