"""Schemas of the data model: files, what is known of a file, and the graph."""

from __future__ import annotations

FILES = "repo_id long, file_ord int, path string, content string, size long"
#: A null array is a key that the language does not have, an empty array one that is there without entries.
FILE_INFO = "repo_id long, path string, ext string, functions array<string>, classes array<string>, imports array<string>, tags array<string>, queries array<string>, type string, name string, size long, error string, file_ord int"
NODES = "repo_id long, id string, type string, label string, shape string, level int"
EDGES = "repo_id long, src string, dst string, relation string, label string"
NODE_LINK = (
    "directed boolean, multigraph boolean, graph map<string,string>, nodes array<struct<id string, type string, label string, shape string, level int>>, links array<struct<source string, target string, relation string, label string>>"
)
