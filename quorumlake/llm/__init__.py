"""Operators for building training corpora: media, token files, joins, filters,
classifiers and mixing.  Nothing outside this subpackage imports it."""
