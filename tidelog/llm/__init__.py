"""Training-data operators: ten pipeline components over documents and pages.

Nothing else in ``tidelog`` imports this subpackage.
"""
