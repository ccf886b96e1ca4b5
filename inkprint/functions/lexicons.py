"""Fixed word lists. All of them are arguments everywhere they are used; these are the defaults."""

from __future__ import annotations

# The ten function words counted one by one.
FUNCTION_WORDS = ["the", "and", "of", "to", "in", "that", "is", "for", "on", "with"]

# The technical terms whose presence is scored.
TECHNICAL_TERMS = [
    "algorithm", "data structure", "complexity", "runtime", "compile", "recursion", "stack", "queue", "tree", "graph",
    "O(", "DFS", "BFS", "node", "edge", "vertex", "search", "traverse", "sort", "merge", "split", "class", "object",
    "inheritance", "encapsulation", "polymorphism", "interface", "abstraction", "function", "method", "variable",
    "parameter", "argument", "type", "static", "dynamic", "compile-time", "run-time", "exception", "error", "bug",
    "debug", "test", "assert", "unit test", "integration", "dependency", "library", "module", "package", "import",
    "export", "API", "SDK", "framework", "design pattern", "SOLID", "principle", "architecture", "component", "system",
]

# A short list of English stop words. Pass your own list, or
# pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"), for a longer one.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each", "either", "else", "every",
    "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "less", "many", "may", "me", "might", "more", "most", "much",
    "must", "my", "neither", "no", "nor", "not", "now", "of", "off", "often", "on", "once", "one", "only", "or",
    "other", "our", "ours", "out", "over", "own", "per", "same", "she", "should", "so", "some", "still", "such",
    "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "upon", "us", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "yet", "you", "your", "yours",
]
