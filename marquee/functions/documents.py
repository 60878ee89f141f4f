"""JSON documents of unknown depth."""

import json
from collections.abc import Iterator


def containers(text: str, last_first: bool = False) -> Iterator[dict | list]:
    """All objects and lists of a JSON text, each before what it holds, siblings in order or the last first; none if it
    is no JSON. The open siblings of each level are kept, so depth and number are not limited."""
    try:
        levels = [iter([v for v in [json.loads(text)] if isinstance(v, (dict, list))])]
    except (ValueError, RecursionError):
        return
    while levels:
        found = next(levels[-1], None)
        if found is None:
            levels.pop()
            continue
        yield found
        held = [v for v in (found.values() if isinstance(found, dict) else found) if isinstance(v, (dict, list))]
        levels.append(reversed(held) if last_first else iter(held))
