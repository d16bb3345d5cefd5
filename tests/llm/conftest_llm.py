"""The helpers of conftest.py under a name that tests can import."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path

_spec = spec_from_file_location("llm_helpers", Path(__file__).with_name("conftest.py"))
_m = module_from_spec(_spec)
_spec.loader.exec_module(_m)
CLASHING, DOCS, WORDS, duck, frame, prose, rows = _m.CLASHING, _m.DOCS, _m.WORDS, _m.duck, _m.frame, _m.prose, _m.rows
