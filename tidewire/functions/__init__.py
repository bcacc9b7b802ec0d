"""tidewire.functions."""
