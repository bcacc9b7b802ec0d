"""tidewire.streaming."""
