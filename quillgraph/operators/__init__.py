"""Graph storage, algebra, closure, comparison, alignment, lifting, lowering and reports."""
