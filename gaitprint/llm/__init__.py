"""Operators for preparing training corpora: tokens, near copies, mixing, media, search and clean-up.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames;
intermediate tables that must not be computed twice are written to the folder that the session names
in ``spark.checkpoint.dir`` (see :mod:`gaitprint.llm.common`).
"""
