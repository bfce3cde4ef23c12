"""The rule catalog and the rules that are exact."""
