"""Patterns by the words a match must hold: a text is read once, whatever the number of patterns."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in one of the small maps that are searched entry by entry.
WORDS_PER_BUCKET = 4
# Characters that part words, in lower-cased text.
ASCII_GAPS, UNICODE_GAPS = r"[^a-z0-9_]+", r"[^\p{L}\p{N}_]+"


class WordIndex:
    """An index from words to entries, as constants of the plan.

    Every entry is a struct of texts and has words of which a text it applies to holds at
    least one (``whole_words``); some words decide alone. The entries' patterns are data,
    not plan: they are compiled only for the few entries whose word a text has.
    """

    def __init__(self, entries: Sequence[dict[str, str]], words: Sequence[dict[str, bool]]) -> None:
        of_word: dict[str, list[dict]] = defaultdict(list)
        for number, own in enumerate(words):
            for word, sure in own.items():
                of_word[word].append({"number": number, "sure": sure})
        self.words = sorted(of_word)
        self.size = max(1, len(self.words) // WORDS_PER_BUCKET)
        buckets: list[dict[str, list[dict]]] = [{} for _ in range(self.size)]
        for word, found in of_word.items():
            buckets[zlib.crc32(word.encode()) % self.size][word] = found
        fields = ", ".join(f"{name}: string" for name in entries[0])
        self.entries = F.from_json(F.lit(json.dumps(entries)), f"array<struct<{fields}>>")
        found = "array<map<string, array<struct<number: int, sure: boolean>>>>"
        self.buckets = F.from_json(F.lit(json.dumps(buckets)), found)

    def matching(self, low: Column, test: Callable[[Column], Column], gaps: str = ASCII_GAPS) -> Column:
        """Entries that match the lower-cased text, each once: those with a word of it that
        decides alone, and those with another word of it for which ``test`` holds."""
        known = F.array_distinct(F.filter(F.split(low, gaps), lambda word: word.isin(self.words)))
        bucket = lambda word: F.get(self.buckets, (F.crc32(word.cast("binary")) % self.size).cast("int"))
        found = F.array_distinct(F.flatten(F.transform(known, lambda word: F.element_at(bucket(word), word))))
        number = lambda entry: entry["number"]
        # An entry may be met by several words, of which some decide.
        matched = F.filter(found, lambda x: x["sure"] | test(F.get(self.entries, x["number"])))
        return F.transform(F.array_distinct(F.transform(matched, number)), lambda n: F.get(self.entries, n))
