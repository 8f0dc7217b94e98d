"""What is loaded once by each worker process: a model, a tokenizer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

#: What this process has loaded, by key.
_HELD: dict[str, Any] = {}


class Loaded:
    """The result of ``load()``, made in each worker process when it is first needed there and kept between tasks.

    What is sent to the tasks is the function alone, so it may name a file that workers
    see, or hold a broadcast variable.
    """

    def __init__(self, load: Callable[[], Any]):
        self.load, self.key = load, uuid.uuid4().hex

    def get(self) -> Any:
        import docquery.functions.loaded as own  # the module of the worker, not a copy of it

        if self.key not in own._HELD:
            own._HELD[self.key] = self.load()
        return own._HELD[self.key]
