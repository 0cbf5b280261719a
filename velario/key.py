"""The key of a job: checked for length, never shown."""

import hashlib
import hmac


class Key:
    """An AES key. ``repr`` gives its public id only, so logs cannot leak it."""

    ID_LABEL = b"velario/key-id"

    def __init__(self, data: bytes, bits=(256,)):
        data = bytes(data)
        if len(data) * 8 not in bits:
            raise ValueError(f"the key must have {' or '.join(map(str, bits))} bits")
        self.bytes = data

    @classmethod
    def of_any_size(cls, data: bytes) -> "Key":
        """A key of any AES size, for known-answer checks."""
        return cls(data, bits=(128, 192, 256))

    def id(self, label: bytes = ID_LABEL) -> str:
        """Public, non-invertible name of the key: 16 hexadecimal digits."""
        return hmac.new(self.bytes, label, hashlib.sha256).hexdigest()[:16]

    def __repr__(self):
        return f"Key(id={self.id()})"
