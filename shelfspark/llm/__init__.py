"""Training-data operators (corpus preparation for language models).

Nothing else in the library imports this subpackage. ``queries`` registers
one ``opN_<name>`` query per operator.
"""
