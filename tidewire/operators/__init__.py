"""tidewire.operators."""
