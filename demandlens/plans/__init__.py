"""End-to-end jobs: linear evaluation, sequence evaluation, comparison."""
