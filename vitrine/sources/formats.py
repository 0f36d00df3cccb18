"""The registry of file formats, and detection by content and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.paths import extension

# Name | extensions | MIME types | category | thumbnail | preview | playback. The first match wins.
FORMATS = """
JPEG Image | jpg jpeg jpe jfif | image/jpeg | Image | NativeImage | BrowserNative | None
PNG Image | png | image/png | Image | NativeImage | BrowserNative | None
WebP Image | webp | image/webp | Image | NativeImage | BrowserNative | None
GIF Image | gif | image/gif | Image | NativeImage | BrowserNative | None
Bitmap Image | bmp | image/bmp | Image | NativeImage | BrowserNative | None
Windows Icon | ico | image/x-icon image/vnd.microsoft.icon | Image | NativeImage | BrowserNative | None
TIFF Image | tif tiff | image/tiff | Image | NativeImage | Convert | None
Windows Cursor | cur | image/x-icon | Image | NativeImage | BrowserNative | None
Targa Image | tga | image/x-tga image/targa | Image | NativeExtractor | Convert | None
Canon Raw | cr2 cr3 crw | image/x-canon-cr2 image/x-canon-crw | Image | Raw | Raw | None
Nikon Raw | nef nrw | image/x-nikon-nef | Image | Raw | Raw | None
Sony Raw | arw srf sr2 | image/x-sony-arw image/x-sony-srf image/x-sony-sr2 | Image | Raw | Raw | None
Adobe DNG | dng | image/x-adobe-dng | Image | Raw | Raw | None
Fujifilm Raw | raf | image/x-fuji-raf | Image | Raw | Raw | None
Olympus Raw | orf | image/x-olympus-orf | Image | Raw | Raw | None
Panasonic Raw | rw2 | image/x-panasonic-rw2 | Image | Raw | Raw | None
Pentax/Epson Raw | pef erf | image/x-pentax-pef image/x-epson-erf | Image | Raw | Raw | None
Hasselblad Raw | 3fr fff | image/x-hasselblad-3fr image/x-hasselblad-fff | Image | Raw | Raw | None
Kodak Raw | dcr kdc | image/x-kodak-dcr image/x-kodak-kdc | Image | Raw | Raw | None
Samsung Raw | srw | image/x-samsung-srw | Image | Raw | Raw | None
Sigma Raw | x3f | image/x-sigma-x3f | Image | Raw | Raw | None
Phase One Raw | iiq | image/x-phaseone-iiq | Image | Raw | Raw | None
Leaf Raw | mos | image/x-leaf-mos | Image | Raw | Raw | None
Leica Raw | rwl | image/x-leica-rwl | Image | Raw | Raw | None
Minolta Raw | mrw | image/x-minolta-mrw | Image | Raw | Raw | None
Generic RAW | raw | image/x-raw | Image | Raw | Raw | None
Blackmagic RAW | braw | application/x-braw | Video | Icon | None | None
RED Video RAW | r3d | application/x-r3d | Video | Icon | None | None
ARRI RAW Video | ari | application/x-ari | Video | Icon | None | None
GoPro RAW | gpr | image/x-gpr | Image | Raw | Raw | None
High Efficiency Image | heic heif | image/heic image/heif | Image | Ffmpeg | Ffmpeg | None
AV1 Image | avif | image/avif | Image | Ffmpeg | Ffmpeg | None
JPEG XL Image | jxl | image/jxl | Image | Icon | None | None
HEIF Image Sequence | heifs | image/heic-sequence | Image | Icon | None | None
AVIF Image Sequence | avifs | image/avif-sequence | Image | Icon | None | None
Apple Icon Image | icns | image/x-icns | Image | Icon | None | None
Scalable Vector Graphics | svg | image/svg+xml | Image | Webview | BrowserNative | None
Adobe Photoshop | psd psb | image/vnd.adobe.photoshop | Project | NativeExtractor | NativeExtractor | None
Adobe Illustrator | ai | application/postscript application/pdf | Image | NativeExtractor | NativeExtractor | None
Encapsulated PostScript | eps | application/postscript | Image | NativeExtractor | NativeExtractor | None
GIMP Image | xcf | image/x-xcf | Project | NativeExtractor | NativeExtractor | None
Aseprite Image | aseprite ase | image/x-aseprite application/x-aseprite | Project | NativeExtractor | NativeExtractor | None
Krita Project | kra krz kra~ | application/x-krita | Project | NativeExtractor | NativeExtractor | None
Adobe InDesign | indd idml | application/x-indesign application/vnd.adobe.indesign-idml-package | Project | Icon | None | None
Sketch Project | sketch | application/x-sketch | Project | NativeExtractor | NativeExtractor | None
MediBang Project | mdp | application/x-medibang-mdp | Project | NativeExtractor | NativeExtractor | None
Figma Project | fig | application/x-figma | Project | NativeExtractor | NativeExtractor | None
PaintTool SAI | sai | application/x-painttool-sai | Project | NativeExtractor | NativeExtractor | None
PaintTool SAI 2 | sai2 | application/x-painttool-sai2 | Project | NativeExtractor | NativeExtractor | None
CorelDraw Image | cdr | application/x-coreldraw | Project | Icon | None | None
PDF Document | pdf | application/pdf | Image | NativeExtractor | BrowserNative | None
Blender Project | blend | application/x-blender | Model3D | NativeExtractor | NativeExtractor | None
FBX Model | fbx | application/octet-stream | Model3D | Model3D | None | None
OBJ Model | obj | model/obj text/plain | Model3D | Model3D | None | None
GL Transmission Format | gltf | model/gltf+json | Model3D | Model3D | None | None
Binary GLTF | glb | model/gltf-binary | Model3D | Model3D | None | None
Collada Model | dae | model/vnd.collada+xml | Model3D | Model3D | None | None
Stereolithography | stl | model/stl application/vnd.ms-pki.stl | Model3D | Model3D | None | None
3D Studio | 3ds | application/x-3ds | Model3D | Model3D | None | None
AutoCAD DXF | dxf | image/vnd.dxf | Model3D | Model3D | None | None
LightWave Object | lwo | image/x-lwo | Model3D | Model3D | None | None
LightWave Scene | lws | image/x-lws | Model3D | Model3D | None | None
USD Binary Model | usdz | model/vnd.usdz+zip | Model3D | Icon | None | None
USD Common Model | usd usda usdc | model/usd | Model3D | Icon | None | None
STEP Model | step stp | application/step | Model3D | Icon | None | None
IGES Model | iges igs | application/iges | Model3D | Icon | None | None
TrueType Font | ttf | font/ttf | Font | Font | None | None
OpenType Font | otf | font/otf | Font | Font | None | None
TrueType Collection | ttc | font/collection font/ttc | Font | Font | None | None
Web Open Font Format | woff | font/woff | Font | Font | None | None
Web Open Font Format 2 | woff2 | font/woff2 | Font | Font | None | None
Embedded OpenType | eof | application/vnd.ms-fontobject | Font | Icon | None | None
Affinity Design | afdesign | application/x-affinity-design | Project | NativeExtractor | NativeExtractor | None
Affinity Photo | afphoto | application/x-affinity-photo | Project | NativeExtractor | NativeExtractor | None
Affinity Publisher | afpub | application/x-affinity-publisher | Project | NativeExtractor | NativeExtractor | None
Clip Studio Paint | clip | application/x-clip-studio-paint | Project | NativeExtractor | NativeExtractor | None
XMind Map | xmind | application/x-xmind | Project | NativeExtractor | NativeExtractor | None
After Effects Project | aep | application/x-aftereffects | Project | Icon | None | None
Premiere Pro Project | prproj | application/x-premiere | Project | Icon | None | None
Final Cut Pro XML | fcpxml | application/x-finalcut-xml | Project | Icon | None | None
DaVinci Resolve Project | drp | application/x-davinci-resolve | Project | Icon | None | None
OpenEXR Image | exr | image/x-exr | Image | NativeExtractor | NativeExtractor | None
Radiance HDR | hdr | image/vnd.radiance | Image | NativeExtractor | NativeExtractor | None
DirectDraw Surface | dds | image/vnd-ms.dds | Image | NativeExtractor | NativeExtractor | None
Netpbm Formats | pbm pgm ppm pnm pam | image/x-portable-bitmap image/x-portable-graymap image/x-portable-pixmap image/x-portable-anymap | Image | NativeExtractor | Convert | None
MPEG-4 Video | mp4 m4v | video/mp4 | Video | Ffmpeg | None | Native
WebM Video | webm | video/webm | Video | Ffmpeg | None | Hls
QuickTime Video | mov qt | video/quicktime | Video | Ffmpeg | None | Native
Matroska Video | mkv | video/x-matroska | Video | Ffmpeg | None | Hls
Matroska Audio | mka | audio/x-matroska | Audio | Icon | None | AudioHls
Material Exchange Format | mxf | application/mxf video/mxf | Video | Ffmpeg | None | Hls
Windows Media Video | wmv asf | video/x-ms-wmv video/x-ms-asf | Video | Ffmpeg | None | Hls
Flash Video | flv f4v | video/x-flv | Video | Ffmpeg | None | Hls
Shockwave Flash | swf | application/x-shockwave-flash | Video | Ffmpeg | None | LinearHls
MPEG-1/2 Video | mpg mpeg m2v | video/mpeg video/mp2p | Video | Ffmpeg | None | LinearHls
MPEG Transport Stream / DVD | vob ts mts m2ts | video/mp2t video/x-m2ts | Video | Ffmpeg | None | Hls
AVI Video | avi divx | video/x-msvideo video/avi | Video | Ffmpeg | None | Hls
3GPP Video | 3gp 3g2 | video/3gpp video/3gpp2 | Video | Ffmpeg | None | Hls
RealMedia Video | rm rmvb | application/vnd.rn-realmedia | Video | Ffmpeg | None | Hls
RealAudio | ra | audio/vnd.rn-realaudio | Audio | Icon | None | AudioHls
Windows Recorded TV Show | wtv | video/x-wtv | Video | Ffmpeg | None | Hls
Ogg Video | ogv | video/ogg | Video | Ffmpeg | None | Hls
Motion JPEG | mjpeg mjpg | video/x-motion-jpeg | Video | Ffmpeg | None | LinearHls
High Efficiency Video Coding | hevc | video/mp4 | Video | Ffmpeg | None | LinearHls
H.264 Raw Video | h264 | video/h264 | Video | Ffmpeg | None | LinearHls
H.265 Raw Video | h265 | video/h265 | Video | Ffmpeg | None | LinearHls
YUV4MPEG2 Video | y4m | video/x-y4m | Video | Ffmpeg | None | LinearHls
MP3 Audio | mp3 | audio/mpeg audio/mp3 | Audio | Icon | None | Native
MPEG-1 Audio Layer II | mp2 | audio/mpeg | Audio | Icon | None | Native
Waveform Audio | wav | audio/wav audio/x-wav audio/wave | Audio | Icon | None | Native
FLAC Audio | flac | audio/flac audio/x-flac | Audio | Icon | None | Native
Ogg Audio | ogg oga |  | Audio | Icon | None | AudioHls
Opus Audio | opus | audio/opus | Audio | Icon | None | AudioHls
MPEG-4 Audio | m4a aac m4r | audio/mp4 audio/aac audio/x-m4a | Audio | Icon | None | Native
Windows Media Audio | wma | audio/x-ms-wma | Audio | Icon | None | AudioHls
AIFF Audio | aiff aif | audio/x-aiff audio/aiff | Audio | Icon | None | AudioHls
Compact AIFF Audio | aifc | audio/x-aiff | Audio | Icon | None | AudioHls
Speex Audio | spx | audio/ogg | Audio | Icon | None | AudioHls
Dolby Digital | ac3 | audio/ac3 | Audio | Icon | None | AudioHls
DTS Audio | dts | audio/vnd.dts | Audio | Icon | None | AudioHls
AMR Audio | amr | audio/amr | Audio | Icon | None | AudioHls
Monkey's Audio | ape | audio/x-ape | Audio | Icon | None | AudioHls
WavPack Audio | wv | audio/wavpack audio/x-wavpack | Audio | Icon | None | AudioHls
Apple Core Audio | caf | audio/x-caf | Audio | Icon | None | AudioHls
Audible Audio | aax | audio/vnd.audible.aax | Audio | Icon | None | AudioHls
MIDI Audio | mid midi | audio/midi | Audio | Icon | None | AudioHls
Broadcast Wave Audio | bwf | audio/x-wav | Audio | Icon | None | AudioHls
"""

COLUMNS = "place int, name string, extensions array<string>, mime_types array<string>, category string, thumbnail string, preview string, playback string"

#: Bytes at the head of a file that tell its type.
HEAD_BYTES = 1024
#: Types that hold others: for these the name decides first.
CONTAINERS = ("image/tiff", "application/zip", "application/octet-stream")

# MIME type, offset, bytes in hex. The first match wins.
MAGIC = (
    ("image/jpeg", 0, "FFD8FF"),
    ("image/png", 0, "89504E470D0A1A0A"),
    ("image/gif", 0, "474946"),
    ("image/webp", 8, "57454250"),
    ("image/bmp", 0, "424D"),
    ("image/tiff", 0, "49492A00"),
    ("image/tiff", 0, "4D4D002A"),
    ("image/vnd.adobe.photoshop", 0, "38425053"),
    ("application/pdf", 0, "25504446"),
    ("application/zip", 0, "504B0304"),
    ("video/x-matroska", 0, "1A45DFA3"),
    ("video/mp4", 4, "66747970"),
    ("video/x-flv", 0, "464C5601"),
    ("audio/mpeg", 0, "494433"),
    ("audio/x-flac", 0, "664C6143"),
    ("audio/ogg", 0, "4F676753"),
    ("audio/midi", 0, "4D546864"),
    ("audio/amr", 0, "2321414D52"),
)


def registry_rows() -> list[tuple]:
    rows = [[x.strip() for x in line.split("|")] for line in FORMATS.strip().split("\n")]
    return [(k, r[0], r[1].split(), r[2].split(), *r[3:]) for k, r in enumerate(rows)]


def registry(spark: SparkSession) -> DataFrame:
    """A row for each format, in order."""
    return spark.createDataFrame(registry_rows(), COLUMNS)


def by_extension(formats: DataFrame, last_wins: bool = False) -> DataFrame:
    """(extension, place, name, category, ...): one format for each extension, the first registered or the last."""
    ways = formats.select(F.explode("extensions").alias("extension"), *(c for c in formats.columns if c != "extensions"))
    rest = F.struct(*(c for c in ways.columns if c != "extension"))
    pick = F.max_by(rest, "place") if last_wins else F.min_by(rest, "place")
    return ways.groupBy("extension").agg(pick.alias("f")).select("extension", "f.*")


def supported(files: DataFrame, formats: DataFrame, path_col: str = "path") -> DataFrame:
    """The rows whose path has an extension of the registry; a semi join with its 171 extensions."""
    known = formats.select(F.explode("extensions").alias("ext_known")).distinct()
    own = files.withColumn("ext_known", extension(F.col(path_col)))
    return own.join(F.broadcast(known), "ext_known", "left_semi").select(files.columns)


def magic_type(head: Column) -> Column:
    """The MIME type that the first bytes tell, or null."""
    found = F.lit(None).cast("string")
    for mime, offset, code in reversed(MAGIC):
        found = F.when(F.hex(F.substring(head, offset + 1, len(code) // 2)) == code, mime).otherwise(found)
    return found


def detect(files: DataFrame, formats: DataFrame, path_col: str = "path", content_col: str | None = "content") -> DataFrame:
    """Add format_name, category and playback to `files`, by their first bytes and else by extension; null where neither is known.

    The registry has under 200 rows and is broadcast, once by MIME type and once by extension.
    """
    mimes = formats.select(F.explode("mime_types").alias("mime"), F.struct("place", "name", "category", "playback").alias("f"))
    of_mime = mimes.groupBy("mime").agg(F.min("f").alias("by_mime"))
    of_ext = by_extension(formats).select("extension", F.struct("place", "name", "category", "playback").alias("by_ext"))
    mime = magic_type(F.substring(F.col(content_col), 1, HEAD_BYTES)) if content_col else F.lit(None).cast("string")
    told = files.withColumn("extension", extension(F.col(path_col))).withColumn("mime", mime)
    met = told.join(F.broadcast(of_ext), "extension", "left").join(F.broadcast(of_mime), "mime", "left")
    by_name_first = F.coalesce(F.col("mime").isin(*CONTAINERS), F.lit(False))
    f = F.when(by_name_first, F.coalesce("by_ext", "by_mime")).otherwise(F.coalesce("by_mime", "by_ext"))
    return met.withColumn("f", f).select(*files.columns, F.col("f.name").alias("format_name"), F.col("f.category").alias("category"), F.col("f.playback").alias("playback"))
