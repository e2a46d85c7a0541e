"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator;
``entries`` lists the registered queries.
"""
