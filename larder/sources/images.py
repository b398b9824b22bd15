"""Optional image steps before text recognition; they need cv2 and pytesseract on the workers."""

from __future__ import annotations

import shutil
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from .products import ocr_result

# Fixed values of the image steps.
LEAST_HEIGHT, CLIP, TILES, STRENGTH, LEAST_ANGLE = 1000, 2.0, 8, 10, 0.5


def steps(content: bytes, deskew: bool = True) -> Iterator[tuple]:
    """(name, picture) of each step in turn: grey, enlarged, contrast, denoised, straightened, black on white; ValueError for what is no image."""
    import cv2
    import numpy as np

    grey = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
    if grey is None:
        raise ValueError("not an image")
    yield "00_grey", grey
    if grey.shape[0] < LEAST_HEIGHT:
        scale = LEAST_HEIGHT / grey.shape[0]
        grey = cv2.resize(grey, None, fx=scale, fy=scale, interpolation=cv2.INTER_CUBIC)
    yield "01_upscaled", grey
    grey = cv2.createCLAHE(CLIP, (TILES, TILES)).apply(grey)
    yield "02_contrast", grey
    grey = cv2.fastNlMeansDenoising(grey, None, STRENGTH, 7, 21)
    yield "03_denoise", grey
    if deskew:
        dark = np.column_stack(np.where(cv2.threshold(grey, 0, 255, cv2.THRESH_BINARY_INV + cv2.THRESH_OTSU)[1] > 0))
        angle = cv2.minAreaRect(dark[:, ::-1].astype(np.float32))[-1] if len(dark) else 0.0
        angle = angle - 90 if angle > 45 else angle
        if abs(angle) >= LEAST_ANGLE:
            h, w = grey.shape
            grey = cv2.warpAffine(grey, cv2.getRotationMatrix2D((w / 2, h / 2), angle, 1.0), (w, h), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
        yield "04_deskew", grey
    out = cv2.threshold(grey, 0, 255, cv2.THRESH_BINARY + cv2.THRESH_OTSU)[1]
    yield "05_binary", 255 - out if out.mean() < 127 else out


def prepare(content: bytes, deskew: bool = True):
    """The last step's picture."""
    return [picture for _, picture in steps(content, deskew)][-1]


def save_steps(content: bytes, stem: str, folder: str) -> dict[str, str]:
    """Writes every step's picture as stem__name.png; the paths by name."""
    import cv2

    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = {}
    for name, picture in steps(content):
        paths[name] = str(Path(folder, f"{stem}__{name}.png"))
        if not cv2.imwrite(paths[name], picture):
            raise OSError(f"cannot write {paths[name]}")
    return paths


def to_pil(picture):
    """A picture of these steps as one of the imaging library."""
    from PIL import Image

    return Image.fromarray(picture)


def locate_recogniser(others: Iterable[str] = ()) -> str:
    """The recogniser's program: on the path, else the first of the others that is a file; RuntimeError if none is."""
    for place in (shutil.which("tesseract"), *others):
        if place and Path(place).is_file():
            return place
    raise RuntimeError("tesseract is not installed")


def languages(folder: str) -> list[str]:
    """Names of the trained languages in a folder, in order; none for a folder that is not there."""
    return sorted(p.stem for p in Path(folder).glob("*.traineddata"))


def recognise(images: DataFrame, languages: str = "por+eng", psm: int = 6) -> DataFrame:
    """(path, ocr) of (path, content): words are recognised in batches on the workers, the rest is native."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pytesseract

        for batch in batches:
            words = []
            for content in batch["content"]:
                d = pytesseract.image_to_data(prepare(content), lang=languages, config=f"--psm {psm}", output_type=pytesseract.Output.DICT)
                words.append([{"text": t, "conf": float(c)} for t, c in zip(d["text"], d["conf"], strict=True)])
            yield pd.DataFrame({"path": batch["path"], "words": words})

    found = images.select("path", "content").mapInPandas(run, "path string, words array<struct<text: string, conf: double>>")
    return found.select("path", ocr_result(found["words"]).alias("ocr"))
