"""Every name that a function takes from its module is there, so that no query finds one missing as it runs."""

import builtins
import dis
import importlib
import pkgutil
import types

import pytest

import waystone

MODULES = sorted(m.name for m in pkgutil.walk_packages(waystone.__path__, "waystone.") if not m.ispkg)


def taken(code):
    """Globals that code reads, those of the functions in it too."""
    yield from (i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME"))
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from taken(c)


@pytest.mark.parametrize("name", MODULES)
def test_names_are_there(name):
    module = importlib.import_module(name)
    with open(module.__file__) as f:
        code = compile(f.read(), module.__file__, "exec")
    inner = [c for c in code.co_consts if isinstance(c, types.CodeType)]
    missing = {n for c in inner for n in taken(c) if not hasattr(module, n) and not hasattr(builtins, n)}
    assert missing - {"__class__", "__name__", "__module__", "__qualname__"} == set()
