"""Sources: the block-log reader, test-table loading and fixture derivation."""
