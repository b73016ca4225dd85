"""Operators for training-data pipelines that work on language-model inputs. Nothing outside this subpackage imports it."""
