import pytest


@pytest.fixture(scope="session")
def model():
    with open("/opt/tokenizers/byte_bpe_50k.json", "rb") as f:
        return f.read()
