"""Recursive-descent parsers that tell whether source text is valid in its language."""

from codectx.llm.syntax import go, java, js, python
from codectx.llm.syntax.core import deep

#: Extension -> (language, parser).
PARSERS = {
    "py": ("python", deep(python.parse)), "js": ("javascript", deep(js.parse)), "ts": ("typescript", deep(js.parse_ts)), "java": ("java", deep(java.parse)), "go": ("go", deep(go.parse)),
}
