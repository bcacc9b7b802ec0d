import pytest

pytest.importorskip("tidewire.llm")
