"""Word-level language identification over mixed-language text, and preparation of training text, on Spark."""

from glossmill.functions.text import LABELS, LANGUAGES
from glossmill.operators.identify import Config, Identifier
from glossmill.operators.views import segments, summarize

__all__ = ["LABELS", "LANGUAGES", "Config", "Identifier", "segments", "summarize"]
